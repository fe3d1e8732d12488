"""Periodic runs, chat formatting and vector codes against brute force, with nulls, ties, repeats, odd texts and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat_format, periodic_runs, vector_codes


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clashing(df, *names):
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


# --- periodic runs


def brute_runs(w, least=periodic_runs.LEAST):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i and not any(all(w[k] == w[k - d] for k in range(i - q + d, j)) for d in range(1, q)):
                out.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 70))]
        if w and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), 1 + rng.randrange(10)
            w = w[:a] + ((w[a : a + p] + ["z"] * p)[:p] * 70)[: len(w) - a]
        assert periodic_runs.runs_of(w) == brute_runs(w)


def test_squares_need_no_stretches():
    """The automaton alone, over whole texts, finds the same runs."""
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        whole = sorted((s, e - s + 1, p) for (s, p), e in periodic_runs.squares(w).items() if e - s + 1 >= max(12, 2 * p))
        assert whole == sorted(brute_runs(w))


def planted_text(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_op11(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "a " * 12, "x y z " * 9, "one\x0btwo\x0cthree\r" * 6, "a\x1cb " * 8, "word"] + [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 90))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (5000, "q " * 30_000 + "end"), (5001, " ".join(str(rng.random()) for _ in range(400)) + " x" * 3)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    write(clashing(docs, "row", "runs", "found", "collapsed", "top", "words"), tmp_path, "documents")
    got = sorted((tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        w = planted_text(doc_id, text)
        runs = brute_runs(w) if len(w) < 5000 else [(0, 30_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        want.append((doc_id, len(runs), s, n, q, None if n is None else 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=str)
    write(docs.limit(0), tmp_path, "documents")
    assert periodic_runs.op11_periodic_runs(spark, str(tmp_path)).count() == 0


def test_runs_keep_other_columns(spark):
    docs = clashing(spark.createDataFrame([(1, "a b " * 10, "kept")], "doc_id long, text string, more string"), "runs", "row")
    r = periodic_runs.with_runs(docs).collect()[0]
    assert r["more"] == "kept" and r["row"] == "clash" and r["collapsed"] == "a b" and [tuple(x) for x in r["runs"]] == [(0, 20, 2)]


# --- chat


HARD = ["", "\\", "### ", "#### ", "\\### User: </turn>\n", "</turn>", "<\\/turn>\\", "@41", "# ## ", "é\U0001f600</turn></turn>", "a: b", "line\nline\r\n"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digests(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of ordered (role, text)."""
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_op12(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, "odd: role\n", "@", "User"]), rng.choice([None, *HARD]) if rng.random() < 0.2 else "".join(rng.choice(HARD) for _ in range(5))))
    rows += [(1, 2, "assistant", "tie b"), (1, 2, "assistant", "tie a"), (1, 2, "assistant", "tie a"), (None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (50, 0, "user", "</turn>" * 100_000), (50, 1, "assistant", "\\" * 200_000)]
    rows += [(60, 2 * i + j, ("user", "assistant")[j], f"{i} {HARD[i % len(HARD)]}") for i in range(700) for j in range(2)]
    rng.shuffle(rows)
    write(clashing(conversations(spark, rows), "piece", "segments", "n", "first"), tmp_path, "conversations")
    got = {r["conv_id"]: r for r in chat_format.op12_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", chat_format.HOSTILE), (-7, 1, "assistant", chat_format.HOSTILE)]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = [(b, c) for _, b, c in sorted((((t is not None, t or 0), ro or "", te or "") for c, t, ro, te in rows if c == conv))]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns)
        state, bad = chat_format.START, None
        for k, (role, _) in enumerate(turns):
            if bad is None and role not in chat_format.CHAT.follows[state]:
                bad = k
            state = role
        assert r["bad_turn"] == bad and r["in_order"] == (bad is None and state == "assistant")
    write(conversations(spark, []), tmp_path, "conversations")
    assert [r["conv_id"] for r in chat_format.op12_chat_format(spark, str(tmp_path)).collect()] == [-7]


def test_segments_are_the_text_and_its_mask(spark):
    rows = [(1, 0, "system", "be </turn> kind"), (1, 1, "user", "### hi"), (1, 2, "assistant", "\\ho")]
    r = chat_format.formatted(conversations(spark, rows)).collect()[0]
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and r["in_order"] and r["bad_turn"] is None
    assert r["formatted"] == "### System: be <\\/turn> kind</turn>\n### User: #\\## hi</turn>\n### Assistant: \\\\ho</turn>\n"
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["\\\\ho"]


def test_pieces_of_a_conversation_chain(spark):
    """A conversation over many range partitions is read as one, and breaks at the right turn."""
    rows = [(1, i, ("user", "assistant")[i % 2], "x" * 50) for i in range(4000)] + [(2, i, ("user", "assistant")[i % 2], "y") for i in range(3001)]
    rows[2501] = (1, 2501, "user", "again")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: r for r in chat_format.formatted(conversations(spark, rows)).select("conv_id", "n_turns", "in_order", "bad_turn").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert tuple(got[1])[1:] == (4000, False, 2501) and tuple(got[2])[1:] == (3001, False, None)


def test_templates_that_can_not_be_read_back_are_refused():
    for wrong in ({"opening": "#"}, {"opening": "aba"}, {"closing": "x\\y"}, {"opening": "<<", "closing": "/<"}, {"labels": {"user": "a: b"}}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


def test_op12_sql_agrees(spark, tmp_path):
    rows = [(1, 0, "user", "### a"), (1, 1, "assistant", None), (1, 1, None, "\\"), (2, 0, "odd", "</turn>"), (None, 0, "user", "x")]
    write(conversations(spark, rows).coalesce(1), tmp_path, "conversations")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = duck.execute(chat_format.SQL)
    columns = [c[0] for c in found.description]
    got = chat_format.op12_chat_format(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


# --- vector codes


def brute_codes(rows, entries=vector_codes.ENTRIES, rounds=vector_codes.ROUNDS):
    """rows (id, vector of Python numbers): codebooks and (code, error) of each, in Python's integers."""
    from fractions import Fraction
    from math import floor

    width = -(-max(len(v) for _, v in rows) // 16) * 16
    ints = [[floor(Fraction(float(np.float32(c))) * 256) for c in v] + [0] * (width - len(v)) for _, v in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    s, codes, errors, books = width // 16, [""] * len(rows), [0] * len(rows), []
    for p in range(16):
        x = [tuple(v[p * s : p * s + s]) for v in ints]
        book = [x[i] for i in first]
        near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            own = {}
            for v in x:
                own.setdefault(near(v, book)[1], []).append(v)
            book = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(book)]
        for i, v in enumerate(x):
            d, k = near(v, book)
            codes[i], errors[i] = codes[i] + f"{k:02x}", errors[i] + d
        books.append(book)
    return books, list(zip(codes, errors))


def check_codes(spark, folder, rows):
    """rows: (vec_id, vector, label)."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    write(clashing(df, "row", "key", "v", "code", "error"), folder, "embeddings")
    got = vector_codes.op13_vector_codes(spark, str(folder)).collect()
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    books, coded = brute_codes([(i, v) for i, v, _ in kept])
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    by_label = {}
    for (_, _, label), (_, e) in zip(kept, coded):
        by_label[label] = by_label.get(label, 0) + e
    long = lambda n: n if n < 2**63 else None
    want = [(i, c, long(e), long(by_label[label]), digest) for (i, _, label), (c, e) in zip(kept, coded)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_op13(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(0, 0.3, 64).astype(np.float32).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(260)]
    hot = rows[5][1]
    rows += [(300 + i, hot, 9) for i in range(150)] + [(7, rows[0][1], 1), (None, rows[1][1], None), (None, rows[1][1], None)]
    rows += [(500, None, 1), (501, [None] + hot[1:], 1), (502, [float("nan")] + hot[1:], 1), (503, [float("inf")] + hot[1:], None)]
    check_codes(spark, tmp_path, rows)


def test_op13_ties_few_rows_and_odd_lengths(spark, tmp_path):
    rng = np.random.default_rng(5)
    check_codes(spark, tmp_path, [(i, [float(c) for c in rng.integers(-2, 3, 32) / 256], i % 2) for i in range(200)])
    check_codes(spark, tmp_path, [(i, [float(i)] * 16, None) for i in range(5)])
    check_codes(spark, tmp_path, [(1, [], 1), (2, [], None)])
    check_codes(spark, tmp_path, [(1, [0.5] * 20, 1), (2, [0.25] * 7, 1), (3, [], None)])


def test_op13_huge_components(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(0, 1, 16) * 10.0 ** rng.integers(-3, 38)).astype(np.float32).tolist(), i % 4) for i in range(150)]
    check_codes(spark, tmp_path, rows + [(900, [float(np.finfo(np.float32).max)] * 16, 1), (901, [float(np.finfo(np.float32).min)] * 16, None)])


def test_op13_empty(spark, tmp_path):
    for rows in ([], [(1, None, 2)]):
        write(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
        assert vector_codes.op13_vector_codes(spark, str(tmp_path)).count() == 0


def test_balls_hold_their_points_and_own_whole():
    """Balls cover their points, cache right sums, and clustered parts are owned by balls rather than by points."""
    rng = np.random.default_rng(8)
    x = (rng.integers(-50, 50, (40, 4))[rng.integers(0, 40, 4000)] * 40 + rng.integers(-6, 7, (4000, 4))).astype(np.int64)
    tree = vector_codes.balls(x)
    counts = np.bincount(tree.of, minlength=len(tree.points))
    for n in range(len(tree.first)):
        ids = tree.order[tree.first[n] : tree.last[n]]
        assert (np.sqrt(((tree.points[ids] - tree.points[tree.pivot[n]]) ** 2).sum(1)) <= tree.radius[n] + 1e-9).all()
        assert (tree.total[n] == (tree.points[ids] * counts[ids][:, None]).sum(0)).all() and tree.count[n] == counts[ids].sum()
    assert sorted(tree.order) == list(range(len(tree.points)))
    entries = x[:64]
    owner, sums, per_entry, whole = vector_codes.walked(tree, entries)
    want = ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (owner[tree.of] == want).all() and (per_entry == np.bincount(want, minlength=64)).all() and whole > 10
    assert all((sums[k] == x[want == k].sum(0)).all() for k in range(64))

"""Line dedup, periodic runs and spelling variants against brute force, with nulls, ties, repeated rows and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphotab.llm import line_dedup, periodic_runs, queries, spelling_variants

SCHEMA = "doc_id long, text string, word string, row string, n long, home string, first string, pos string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", "r", 1, "h", "f", "p") for i, t in rows], SCHEMA).repartition(3)


# --- lines


def kept_lines(rows, least):
    rank = lambda i: (i is None, i or 0)
    key = lambda line: line.strip(BLANKS).translate(LOW)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, rank(i)), rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == rank(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = [
    (1, "a line of text\n  A Line OF text \nshort\nÉcole du soir"),
    (2, "a line of text\nx\nécole du soir\nother line here"),
    (2, "a line of text\nx\nécole du soir\nother line here"),
    (2, "another text of one id\nother line here\n"),
    (3, None),
    (4, ""),
    (5, "other line here"),
    (6, "École du soir\na line of text\t\nunique thing\n\n"),
    (7, "\x0bunique thing \r\nnine char\nten chars!"),
    (8, "nine char\nten chars!\n ten chars!"),
    (9, "x" * 200_000 + "\n" + "y" * 11 + "\n" * 5000 + "y" * 11),
    (10, "y" * 11 + "\n" + "x" * 200_000),
    (None, "a line of text\nnull line only"),
    (None, "NULL line only\n"),
]


@pytest.mark.parametrize("hot", [2000, 4, 10**9])
def test_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(hot)
    some = ["line number %d of many" % k for k in range(12)] + ["brief", ""]
    rows = LINES + [(20 + k, "\n".join(rng.choices(some, k=rng.randrange(9)))) for k in range(60)]
    out = line_dedup.without_repeated_lines(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out), key=str) == kept_lines(rows, 10)


def test_keep_bitmaps(spark):
    out = {r.doc_id: r.keep for r in line_dedup.keep_bitmaps(frame(spark, [(1, "aaaaaaaaaaa\nb\nccccccccccc"), (2, "ccccccccccc\nx\ny\nAAAAAAAAAAA\nccccccccccc"), (3, None)])).collect()}
    assert out == {1: [3], 2: [0, 1, 2, 2, 0], 3: [1]}


def test_lines_of_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "a line of text"), ("a", "a line of text")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()} == {"a": "a line of text", "b": ""}
    assert line_dedup.without_repeated_lines(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_line_ranges_need_no_second_shuffle(spark):
    plan = line_dedup.repeated_lines(frame(spark, LINES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0


# --- runs


def all_runs(w, least, times):
    out = []
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if n >= max(least, times * p) and all(any(w[s + k] != w[s + k + q] for k in range(n - q)) for q in range(1, p)):
                out.append((s, n, p))
    return sorted(out)


def test_runs_of_random_words():
    rng = np.random.default_rng(0)
    for t in range(600):
        n, k = int(rng.integers(0, 70)), int(rng.integers(1, 4))
        w = rng.integers(0, k, n).tolist()
        if n > 10 and t % 3 == 0:
            a, p = int(rng.integers(0, n)), 1 + int(rng.integers(0, 6))
            w[a:] = [w[a + i % p] for i in range(n - a)]
        least, times = [(24, 3), (4, 2), (6, 3), (10, 4)][t % 4]
        assert periodic_runs.runs_of(np.array(w, np.uint64), least, times) == all_runs(w, least, times)


def test_windows():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5, 16, 21):
        w = np.concatenate((rng.integers(0, 3, 40), rng.integers(0, 9, 30))).astype(np.uint64)
        seen = Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
        expected = [i + width <= len(w) and seen[tuple(w[i : i + width])] > 1 for i in range(len(w))]
        assert periodic_runs.repeated_windows(w, width).tolist() == expected


def run_rows(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        found = all_runs(w, 24, 3)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        out.append((i, len(w), found, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_periodic_runs(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("abcdef", k=30)) + " " + " ".join((rng.choices("xyzé", k=rng.randrange(1, 9)) * 9)[: rng.randrange(80)])) for k in range(60)]
    rows += [(70, None), (71, ""), (72, " \n"), (73, "a " * 24), (74, "a " * 23), (None, "b\n\x0bc " * 15), rows[0], (75, " ".join(f"w{k % 50}" for k in range(400)))]
    rows.append((76, "go " * 300 + "stop"))
    out = periodic_runs.periodic_runs(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out), key=str) == run_rows(rows)
    assert sum(len(r.runs) for r in out) > 20
    assert periodic_runs.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "one two " * 200_000 + "end"
    r = periodic_runs.periodic_runs(frame(spark, [(1, text)])).first()
    assert [tuple(x) for x in r.runs] == [(0, 400_000, 2)] and r.collapsed == "one two end"


def test_registered_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["the", "of", "a", "stone", "river", "é"], k=rng.randrange(150)))) for k in range(150)] + [(200, None), (None, "x y")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        w, h = (t or "").split(), None if i is None else zlib.crc32(str(i).encode())
        g, n = (h or 0) // 10, len(w)
        if h is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        (_, _, found, rest) = run_rows([(i, " ".join(w))])[0]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if found else None
        expected.append((i, len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(rest)))
    out = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted(expected, key=str)
    assert sum(r[1] for r in out) > 5


# --- spelling variants


def variants(rows, shortest, least, times, every):
    counts = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if every and h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= shortest:
                counts[r] += 1
    words = {w: n for w, n in counts.items() if n >= least}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            x = w[:i] + w[i + 1 :]
            if x in words:
                near[w].add(x)
                near[x].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= times * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def letters(rng, n, alphabet):
    return "".join(rng.choices(alphabet, k=n))


@pytest.mark.parametrize(("leaf", "parts", "piece"), [(30_000, 1000, 200_000), (15, 10**6, 20)])
def test_variants(spark, monkeypatch, leaf, parts, piece):
    monkeypatch.setattr(spelling_variants, "LEAF", leaf)
    monkeypatch.setattr(spelling_variants, "PARTS", parts)
    monkeypatch.setattr(spelling_variants, "PIECE", piece)
    rng = random.Random(leaf)
    words = [letters(rng, rng.randrange(6, 12), "abqrÀé") for _ in range(300)]
    words += [letters(rng, rng.randrange(4, 7), "ab") for _ in range(60)]  # many near words
    words += ["a" * 80, "a" * 81, "a" * 79 + "b", "abcdefg" * 9, "abcdefg" * 4 + "xabcdef" * 5, "harbour", "Harbour", "HARBOÜR", "harbor", "harbours"]
    chain = ["lantern"] * 300 + ["lanterne"] * 30 + ["lanternes"] * 3
    rows = [(k, " ".join(rng.choices(words, k=40)) + "," + "-".join(rng.choices(chain, k=20))) for k in range(80)]
    rows += [(90, None), (91, ""), (None, "lantern lantern straße naïveté×÷"), rows[0], rows[0]]
    for shortest, least, times, every in ((7, 2, 10, 31), (4, 1, 3, 2)):
        out = spelling_variants.spelling_variants(frame(spark, rows), shortest, least, times, every)
        got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()}
        assert got == variants(rows, shortest, least, times, every)
    assert any(f != r and f for _, f, r, *_ in got)
    assert spelling_variants.spelling_variants(frame(spark, rows).limit(0)).count() == 0
    assert out.select(F.count("*"), F.countDistinct("word")).first()[:] == (len(got), len(got))


def test_registered_variants(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == variants(rows, 7, 2, 10, 31)

"""Vector codes, toxicity and spelling variants against brute force, and at the borders."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import spelling, toxicity, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


# 11: vector codes ----------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (id, vector, label) -> [(id, code, error, label_error, sha)], in plain whole numbers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for length in {len(v) for _, v, _ in kept}:
        own = sorted(((i, v, y) for i, v, y in kept if len(v) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        width = max(1, -(-length // parts))
        cut = [[(v + [0] * (parts * width - length))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in own]
        books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

        def assigned(p):
            return [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for c in cut]

        for _ in range(rounds):
            for p in range(parts):
                codes = [a[1] for a in assigned(p)]
                for k in range(len(books[p])):
                    mine = [cut[n][p] for n in range(len(cut)) if codes[n] == k]
                    if mine:
                        books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
        final = [assigned(p) for p in range(parts)]
        sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for n, (i, _, y) in enumerate(own):
            out.append((i, "".join(f"{final[p][n][1]:02x}" for p in range(parts)), sum(final[p][n][0] for p in range(parts)), y, sha))
    total = {}
    for *_, error, y, _ in out:
        total[y] = total.get(y, 0) + error
    return sorted(((i, c, e, total[y], s) for i, c, e, y, s in out), key=str)


def got_codes(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, "clash", "clash") for i, v, y in rows], VECTORS)
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **options).collect()), key=str)


def floats(draw, n, length, spread=1.0):
    return [(i, [float(np.float32(draw.gauss(0, spread))) for _ in range(length)], draw.choice([None, 1, 2])) for i in range(n)]


def test_codes_match_plain_arithmetic_with_nulls_ties_and_repeats(spark):
    draw = random.Random(11)
    rows = floats(draw, 60, 16)
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None), (61, None, 1), (62, [None] + [1.0] * 15, 1), (63, [float("nan")] * 16, 1), (64, [float("inf")] * 16, 2)]
    rows += [(70 + k, [0.0] * 16, 2) for k in range(20)]  # ties, zeros are kept
    assert got_codes(spark, rows) == brute_codes(rows)


def test_codes_of_few_rows_odd_lengths_and_nothing(spark):
    draw = random.Random(12)
    rows = floats(draw, 5, 12) + floats(draw, 9, 8) + [(90, [], 1), (91, [-1.5], 1)]
    assert got_codes(spark, rows) == brute_codes(rows)
    assert got_codes(spark, []) == []


def test_slices_find_the_nearest_of_many_entries():
    draw = np.random.default_rng(5)
    for k in (1, 2, 63, 64, 65, 130):
        book, x = draw.integers(-9, 9, (k, 4)), draw.integers(-12, 12, (400, 4))
        code, best = vector_codes.Slices(book).nearest(x)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()


def test_box_holds_few_candidates():
    draw = np.random.default_rng(6)
    s = vector_codes.Slices(draw.integers(-4000, 4000, (16, 8)))
    inside = s.candidates(s.book, np.full(16, 1))
    assert (inside[:, 0] == np.uint64(1) << np.arange(16, dtype=np.uint64)).all()


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        got_codes(spark, [(1, [1e12] * 8, 1)])


def test_many_labels_are_joined_in_parts(spark, monkeypatch):
    draw = random.Random(13)
    rows = floats(draw, 30, 8)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    assert got_codes(spark, rows) == brute_codes(rows)


# 12: toxicity --------------------------------------------------------------------------------


def random_vectors(draw, n, words):
    out = []
    for _ in range(n):
        terms = np.sort(draw.choice(words, draw.integers(1, 5), replace=False))
        out.append((terms, draw.integers(1, 4, len(terms)).astype(float)))
    return out


def test_block_max_search_is_exact():
    draw = np.random.default_rng(7)
    words = 12
    idf = draw.uniform(0.1, 6, words)
    examples = random_vectors(draw, 700, words)
    ids = draw.permutation(5000)[:700].tolist()
    index = toxicity.build_index(ids, draw.integers(0, 2, 700).tolist(), examples, idf)
    dense = np.zeros((700, words))
    for i, (t, f) in enumerate(examples):
        dense[i, t] = toxicity.unit_weights(f, idf[t])
    for t, f in random_vectors(draw, 60, words):
        w = toxicity.unit_weights(f, idf[t])
        cosine = np.round(dense[:, t] @ w, 12)
        want = [ids[i] for i in np.lexsort((ids, -cosine)) if cosine[i] > 0][:16]
        found, scores = toxicity.nearest(index, t, w, 16)
        assert np.allclose(scores, np.sort(cosine)[::-1][: len(scores)])
        assert [int(index.ids[e]) for e in found] == want


def test_search_leaves_an_example_out_of_its_own_vote():
    index = toxicity.build_index([5, 6], [1.0, 0.0], [(np.array([0]), np.array([1.0]))] * 2, np.ones(2))
    found, _ = toxicity.nearest(index, np.array([0]), np.array([1.0]), 5, without=0)
    assert index.ids[found].tolist() == [6]


DOCS = "doc_id long, text string, score double, lang string, i long, y int"


def corpus(spark, n=700, seed=3):
    """Every fifth text has a marked word; (documents, labels, the marked)."""
    draw = random.Random(seed)
    rows, labels, marked = [], [], set()
    for i in range(n):
        words = ["".join(draw.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(8, 60))]
        if i % 5 == 0:
            marked.add(i)
            for _ in range(max(1, len(words) // 15)):
                words.insert(draw.randrange(len(words)), "Zorg" + draw.choice(["", "ka", "mi", "te", "solo"]))
        rows.append((i, " ".join(words), 0.0, "en", 1, 1))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels, marked


def test_toxic_words_and_their_forms_are_learned(spark):
    rows, labels, marked = corpus(spark)
    longest = " ".join(r[1] for r in rows if r[0] not in marked) + " zorgruru" * 400
    rows += [(900, None, 0.0, "en", 1, 1), (901, "", 0.0, "en", 1, 1), (None, "zorgkaru zorg lo", 0.0, "en", 1, 1), (None, "zorgkaru zorg lo", 0.0, "en", 1, 1), (902, longest, 0.0, "en", 1, 1)]
    labels += [(None, 1), (5, None), (10, 1), (10, 0)]
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    wrong = [i for i in range(700) if (score[i] >= 0.5) != (i in marked)]
    assert not wrong
    assert score[900] == score[901] < 0.1 and score[902] >= 0.5 and score[None] >= 0.5
    near = next(r for r in got if r.doc_id == 0)
    assert near.n_neighbours == 16 and set(map(int, near.evidence.split(","))) <= {i for i in marked if zlib.crc32(str(i).encode()) % 5}


def test_labels_of_held_out_rows_do_not_count(spark):
    rows, labels, _ = corpus(spark, 300)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    docs = spark.createDataFrame(rows, DOCS)
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels_or_rows(spark):
    rows, _, _ = corpus(spark, 20)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), none).collect()} == {0.1}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_near_copies_are_one_example(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, base + (" more" if i % 2 else ""), 0.0, "en", 1, 1) for i in range(40)]
    labels = [(i, 1) for i in range(40)]
    got = toxicity.labelled_examples(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text", "toxic", 1000).collect()
    assert len(got) == 1 and got[0].y == 1.0


# 13: spelling variants -----------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows, step, least=5, letters=6, ratio=5):
    count = {}
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % step == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= letters:
                count[run] = count.get(run, 0) + 1
    words = {w: n for w, n in count.items() if n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def got_spelling(spark, rows, step):
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    return sorted(tuple(r) for r in spelling.spelling_variants(df, step=step).collect())


@pytest.mark.parametrize("seed,part_rows", [(1, 2048), (2, 2)])
def test_spelling_matches_all_pairs(spark, monkeypatch, seed, part_rows):
    draw = random.Random(seed)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (part_rows,))
    monkeypatch.setattr(spelling.group_variants, "__defaults__", (spelling.RATIO, part_rows))
    bits = ["ab", "ba", "aa", "é", "ß", "xa", "ö", "×", "bab"]
    base = ["".join(draw.choice(bits) for _ in range(draw.randint(4, 7))) for _ in range(60)]
    texts = []
    for i in range(120):
        own = []
        for w in draw.choices(base, [1 / (k + 1) for k in range(60)], k=60):
            if draw.random() < 0.3:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + "a" + w[at:], w[:at] + "b" + w[at + 1 :]])
            own.append(w.upper() if draw.random() < 0.2 and w.isascii() else w)
        texts.append((i, draw.choice([" ", "-", "1", "\n", "ſ"]).join(own)))
    rows = texts + [(500, None), (501, ""), (None, texts[0][1]), (7, texts[7][1]), (7, texts[7][1])]
    want = brute_spelling(rows, 7)
    assert got_spelling(spark, rows, 7) == want
    assert sum(r[4] for r in want) > 100 and any(r[1] for r in want)


def test_spelling_of_long_texts_chains_and_nothing(spark):
    chain = [("abcdefgh", 3000), ("abcdefghi", 500), ("abcdefghij", 90), ("abcdefghijk", 10)]
    rows = [(1, " ".join(w for w, n in chain for _ in range(n)))]
    got = {r[0]: r for r in got_spelling(spark, rows, 1 << 40)}
    assert [got[w][2] for w, _ in chain] == ["abcdefgh"] * 4 and got["abcdefghijk"][1] == "abcdefghij"
    assert got_spelling(spark, [], 199) == [] and got_spelling(spark, [(1, "abc abc"), (2, None)], 199) == []


def test_pivots_are_two_disjoint_rare_bigrams():
    draw = random.Random(9)
    for _ in range(300):
        prefix = [(p, k, draw.randint(1, 50)) for k, p in enumerate(draw.sample(range(12), 5))]
        want = min(a[2] + b[2] for a in prefix for b in prefix if a[0] + 2 <= b[0]) if any(a[0] + 2 <= b[0] for a in prefix for b in prefix) else None
        got = spelling.pivots_of(prefix)
        if want is not None:
            assert sum(x[2] for x in got) == want and got[0][0] + 2 <= got[1][0]


def test_most_pairs_are_never_formed(spark):
    """Of words with nothing in common none is compared: the join's candidates stay far below all pairs."""
    draw = random.Random(10)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(w, 5) for w in set(words)], "word string, n long")
    assert spelling.near_pairs(df).count() == sum(one_edit(a, b) for a in set(words) for b in set(words) if a < b)


def test_word_counts_are_native(spark):
    plan = spelling.words_of(spark.createDataFrame([(1, "Straße")], "doc_id long, text string"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and plan.where(F.col("n") > 0).count() == 0

"""The corpus operators against brute force, and at the borders: nulls, empty and long texts, ties, repeats, clashing names."""

import gzip
import hashlib
import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from panelwright.llm import ann, decontaminate, html_text, mixing, near_dups, quality, secrets, token_files, url_filters, warc
from panelwright.llm.components import components
from panelwright.llm.common import scratch

EMPTY = hashlib.sha256(b"").hexdigest()


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "src0", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cid string, score int")


# 1 -------------------------------------------------------------------------------------------


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_secrets_match_plain_patterns(spark):
    draw = random.Random(4)
    bits = ["password", "PassWd", "secret_token", "api_key", "APIKEY", ' : "', "=", "AKIA", "A" * 18, "0f" * 13, "é", "ſecret=", "漢", " ", "x.y", "abcdef", "\n", "'", "İ"]
    texts = ["".join(draw.choice(bits) for _ in range(40)) for _ in range(300)] + [None, ""]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert want == ",".join(s for s in got[i].spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
    assert got[301].base_sha256 == EMPTY and got[300].spans == ""


def test_checksummed_tokens_only_with_a_right_checksum():
    body = b"a1B2" * 7 + b"zz"
    good = "ghp_" + (body + secrets.checksum62(body)).decode()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    a = secrets.keyword_automaton()
    assert [s[2] for s in secrets.secret_spans(f"x {good} y", a)] == ["github"] and secrets.secret_spans(f"x {bad} y", a) == []


def test_secrets_of_long_texts_repeats_and_nothing(spark):
    long = "token " * 300_000 + "password=abcdef1 " + "0" * 100_000
    d = docs(spark, [long, "password: hunter22"]).unionByName(docs(spark, [None, "password: hunter22"]).where("doc_id = 1"))
    got = secrets.scan_secrets(d).orderBy("doc_id").collect()
    assert got[0].spans == "assign:1800000:1800016,hex:1800017:1900017" and [r.n_assign for r in got] == [1, 1, 1]
    assert secrets.scan_secrets(docs(spark, [])).count() == 0


# 2 -------------------------------------------------------------------------------------------


def brute_components(rows, width, numerator):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= numerator * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def varied(draw, base, changes):
    w = base.split()
    for _ in range(changes):
        w[draw.randrange(len(w))] = f"w{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small,levels,block", [(2048, 8, 256), (8, 8, 6), (8, 2, 6), (2048, 8, 6)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small, levels, block):
    monkeypatch.setattr(near_dups, "SMALL", small)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "MOST_LEVELS", levels)
    draw = random.Random(small + levels)
    words = [f"v{i}" for i in range(200)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one two"]
    for _ in range(6):
        base = " ".join(draw.choice(words) for _ in range(120))
        texts += [base] * 2 + [varied(draw, base, draw.choice([0, 1, 2, 3, 4, 6])) for _ in range(12)]
    texts += [" ".join(draw.choice(words) for _ in range(80)) for _ in range(20)]
    texts += ["long " * 30_000 + "end", "long " * 30_000 + "end"]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in near_dups.near_duplicates(d).collect()}
    want = brute_components(list(enumerate(texts)), 3, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values()) and got[0].n_shingles == 0 and got[5].n_shingles == 1


def test_near_duplicates_of_nothing_and_of_repeated_and_null_ids(spark):
    empty = docs(spark, []).limit(0)
    assert near_dups.near_duplicates(empty).count() == 0
    d = spark.createDataFrame([(1, "a b c d"), (1, "x y z u"), (2, "x y z u"), (None, "a b c d"), (None, "q r s t"), (7, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id or -1) for r in near_dups.near_duplicates(d).collect()))
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1), (7, 1)]


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 10 for i in range(10, 16)}}


def test_intermediate_tables_are_deleted_behind_the_result(spark):
    from pathlib import Path

    from panelwright.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    got = near_dups.near_duplicates(docs(spark, ["a b c d e", "a b c d e", "x y z", None]))
    left = set(folder.iterdir()) - before
    assert len(left) == 1 and "near-duplicates" in left.pop().name
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


# 3 -------------------------------------------------------------------------------------------


def test_warc_round_trip_and_revisits(spark):
    big, odd = "x" * 1500, "é\r\n\r\nWARC/1.1\r\n\x00" * 120
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", odd), (None, "u", odd), (3, "u", big), (9, "u", "long " * 400_000)]
    path = scratch(spark, "test")
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("digest", "salt", "refers_to", "_may", "head")})
    warc.archive(d, path, "2020-01-02T03:04:05Z", 2000)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert by[1] == [("revisit", 3, 1500)] and by[2] == [("revisit", 3, 1500)] and by[3] == [("response", None, 1500)] * 2
    assert by[4] == by[5] == [("response", None, 5)] and by[6] == by[7] == [("response", None, 0)] and by[None][0][:2] == ("revisit", 8)
    assert [r.payload for r in got if r.page_id == 8] == [odd] and by[9] == [("response", None, 2_000_000)]
    assert next(r for r in got if r.page_id == 1).payload_digest == hashlib.sha1(big.encode()).hexdigest()


def test_archive_files_are_valid(spark):
    rows = [(i, f"http://a/{i}", str(i) * 3000) for i in range(40)]
    path = scratch(spark, "test")
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, file_bytes=1000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    assert len(files) > 4 and all(len(f) < 2500 for f in files)
    seen = set()
    for data in files:
        members = list(warc._members(data))
        assert members[-1] == b"" and gzip.decompress(data) == b"".join(members)  # the file as a whole, too, is gzip
        heads = [h for h, _ in warc._records(data)]
        assert heads[0]["WARC-Type"] == "warcinfo" and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in heads)
        seen |= {h["WARC-Record-ID"] for h in heads[1:]}
    assert len(seen) == 40
    empty = scratch(spark, "test")
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


# 4 -------------------------------------------------------------------------------------------


def taken_by_hand(rows, share, epochs_most, seed):
    """rows: (id, lang, source, tokens).  The same rules in plain Python, with fractions."""
    dom = lambda s: "web" if s == "src0" else "forum" if s and re.fullmatch("src[1-9]", s) else "books"
    leaf = {}
    for i, lang, s, n in rows:
        leaf.setdefault((dom(s), lang, s), []).append((i, n))

    def deal(budget, kids):  # kids: name -> (weight, room)
        given, open_ = {}, dict(kids)
        while True:
            total = sum(w for w, _ in open_.values())
            left = budget - sum(given.values())
            full = [k for k, (w, r) in open_.items() if r * total <= left * w]
            if not full:
                return given | {k: left * w // total for k, (w, _) in open_.items()}
            for k in full:
                given[k] = open_.pop(k)[1]
            if not open_:
                return given

    room = lambda keys: sum(n for k in keys for _, n in leaf[k]) * epochs_most
    every = sum(n for v in leaf.values() for _, n in v)
    domains = sorted({k[0] for k in leaf})
    top = deal(min(every * round(share * 1000) // 1000, room(leaf)), {d: (mixing.DOMAIN_WEIGHTS.get(d, 1), room([k for k in leaf if k[0] == d])) for d in domains})
    out = {}
    for d in domains:
        langs = {k[1] for k in leaf if k[0] == d}
        mid = deal(top[d], {x: (mixing.LANG_WEIGHTS.get(x, 1), room([k for k in leaf if k[:2] == (d, x)])) for x in langs})
        for x in langs:
            own = [k for k in leaf if k[:2] == (d, x)]
            for k, b in deal(mid[x], {k: (1, room([k])) for k in own}).items():
                total = sum(n for _, n in leaf[k])
                e, rest = divmod(b, total) if total else (0, 0)
                at = 0
                order = sorted(leaf[k], key=lambda r: hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest())
                for i, n in order:
                    out[i] = e + (1 if at < rest else 0)
                    at += n
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_mixing_matches_plain_python(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket)
    draw = random.Random(2)
    rows = [(i, draw.choice(["en", "de", None]), draw.choice(["src0", "src0", "src1", "src12", None]), draw.randrange(0, 40)) for i in range(300)]
    d = spark.createDataFrame([(i, "w " * n if n else None, a, s, "clash") for i, a, s, n in rows], "doc_id long, text string, lang string, source string, budget string")
    for share, most in ((0.6, 3), (0.8, 1), (2.5, 3)):
        keys, cuts = mixing.mix(d, share=share, max_epochs=most)
        out = keys.join(cuts, F.expr("domain <=> _domain AND lang <=> _lang AND source <=> _source")).select("doc_id", mixing.times_taken().alias("n"))
        assert dict(map(tuple, out.collect())) == taken_by_hand(rows, share, most, mixing.SEED)


def test_a_null_domain_has_a_budget(spark):
    d = spark.createDataFrame([(i, "w " * 10, "en", f"src{i % 2}") for i in range(40)], "doc_id long, text string, lang string, source string")
    keys, cuts = mixing.mix(d, domain=F.when(F.col("source") == "src0", "web"), share=0.5, max_epochs=1)
    got = {r["_domain"]: r.budget for r in cuts.collect()}
    assert set(got) == {"web", None} and sum(got.values()) in (199, 200) and got[None] > 0


def test_mixing_of_nothing(spark):
    keys, cuts = mixing.mix(docs(spark, []).limit(0))
    assert keys.count() == 0 and cuts.count() == 0


# 5 -------------------------------------------------------------------------------------------


def test_url_rules_match_brute_force(spark):
    draw = random.Random(3)
    labels_ = ["a", "b", "example", "org", "com", "xn--p"]
    rules = [(draw.randrange(2), ".".join(draw.choice(labels_) for _ in range(draw.randrange(1, 4))), draw.choice(["/", "/x", "/x/y", "", "/é"]), draw.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(h, p): (n, h, p, v) for n, h, p, v in rules}.values())
    urls = [None, "no scheme", "http://", "https://ORG/x?y#z", "a://b.org:80/x", "http://com#f"] + ["http://" + ".".join(draw.choice(labels_) for _ in range(draw.randrange(1, 5))) + draw.choice(["", "/", "/x", "/x/y/z", "/é?q", "?x"]) for _ in range(300)] + ["http://a.b.com/x"] * 50
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.id: r for r in url_filters.judge_urls(d, spark.createDataFrame(rules, url_filters.RULE_SCHEMA), ranges=7).collect()}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(-n, len(h) + len(p), h, p, v) for n, h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda r: r[:2]) if fit else None
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((best[2] + best[3], best[4]) if best else (None, "allow")) or (best and sum(f[:2] == best[:2] for f in fit) > 1)


def test_path_rules_of_a_host():
    draw = random.Random(4)
    for _ in range(200):
        paths = {"".join(draw.choice("ab/") for _ in range(draw.randrange(0, 7))) for _ in range(draw.randrange(1, 30))}
        h = url_filters.HostRules("k")
        h.rules = [(0, p, "h", "allow") for p in paths]
        url = "".join(draw.choice("ab/") for _ in range(draw.randrange(0, 10)))
        assert [r[1] for r in h.covering(url)] == sorted((p for p in paths if url.startswith(p)), key=len, reverse=True)


def test_long_urls_repeats_and_hot_keys(spark):
    rows = [(i % 3 or None, "http://one.org/" + "x" * (100_000 if i == 5 else 3)) for i in range(300)]
    d = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    got = url_filters.judge_urls(d, spark.createDataFrame(url_filters.CONTRACT_RULES, url_filters.RULE_SCHEMA), ranges=6)
    assert got.count() == 300 and got.where("rule = 'org/'").count() == 300 and got.where("id IS NULL").count() == 100
    assert got.where("length(path) = 100001").count() == 1


def test_urls_of_nothing(spark):
    d = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge_urls(d, spark.createDataFrame(url_filters.CONTRACT_RULES, url_filters.RULE_SCHEMA)).count() == 0


# 6 -------------------------------------------------------------------------------------------


def brute_cut(prefer, edges):
    n, best = len(prefer), None
    for mask in range(1 << n):
        side = [bool(mask >> i & 1) for i in range(n)]
        cost = sum(p if not s else 0 for p, s in zip(prefer, side) if p > 0) + sum(-p if s else 0 for p, s in zip(prefer, side) if p < 0) + sum(w for a, b, w in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_is_minimal():
    draw = random.Random(5)
    for _ in range(40):
        n = draw.randrange(1, 9)
        prefer = [draw.randrange(-50, 51) for _ in range(n)]
        edges = [(a, b, draw.randrange(1, 40)) for a in range(n) for b in range(a + 1, n) if draw.random() < 0.4]
        side = html_text.content_side(prefer, edges)
        cost = sum(p for p, s in zip(prefer, side) if p > 0 and not s) + sum(-p for p, s in zip(prefer, side) if p < 0 and s) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost == brute_cut(prefer, edges)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all.</div><article><h1>Head&nbsp;line</h1><p>First   para &lt;one&gt;<br>next line.<p>Second <b>bold</b> text.<script>var x = "<p>no</p>";</script></p>
<aside>Related stories, read them all today.</aside><!-- <p>hidden</p> --><div class="comments"><p>I think this is a very good article, thank you.</p></div></article>
<form><label>Your mail</label><button>Go</button></form><footer>&copy; me</footer></body>"""


def test_main_text(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "Long words, long text. " * 20000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.extract_text(d).collect()}
    assert got[1].text == "Head line\nFirst para <one> next line.\nSecond bold text."
    assert got[2].text == "" and got[None].n_chars == 0 and got[3].n_chars == len(got[3].text) > 400_000


PLANTED = {
    "<body><p>Short text</p></body>": "Short text",
    "<div class='share-story'><h1>Head</h1><p>An article of some length, with a comma and an end.</p><p>Another one that goes on for a while, then ends.</p></div>": "Head\nAn article of some length, with a comma and an end.\nAnother one that goes on for a while, then ends.",
    "<p>A full paragraph of good length, it ends here and says something.</p><p>OK</p>": "A full paragraph of good length, it ends here and says something.\nOK",
    "<p>Text of the article is here, it is long enough to be one.</p><ul><li><a href=1>Home</a></li><li>Contact</li><li><a href=2>More</a></li></ul>": "Text of the article is here, it is long enough to be one.",
    "<form><article><p>In a form. All of it.</p></article><label>Mail</label></form>": "In a form. All of it.",
    "<article><p>One.</p><p><a href=x>a link</a></p><div class='post-comments'><p>I liked this long article, thank you very much.</p></div></article>": "One.\na link",
    "<div class=related><p>Read these other stories, they are very good ones.</p></div><p>x</p>": "x",
    "<tr><td>a<td>b<tr><td>c</table></p>": "a\nb\nc",
}


def test_planted_pages():
    for page, text in PLANTED.items():
        assert html_text.main_text(page) == text, page


def test_the_cut_decides_and_is_minimal():
    flipped = 0
    for page in PLANTED:
        blocks = html_text.blocks_of(page)
        prefer, edges = html_text.preferences(blocks, html_text.PLAIN_WEIGHTS), html_text.edges_of(blocks)
        side = html_text.kept_blocks(blocks)
        flipped += sum((p > 0) != s for p, s in zip(prefer, side))
        cost = sum(abs(p) for p, s in zip(prefer, side) if (p > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost == brute_cut(prefer, edges)
    assert flipped >= 2  # a heading of a doubtful element, a line without a link in a list of links


def test_deep_and_broken_pages():
    t = time.process_time()
    assert html_text.main_text("<div>x" * 50_000).count("x") == 50_000
    assert html_text.main_text("<ul><li><div>" * 20_000 + "<li></li>" * 20_000) == ""
    assert html_text.main_text("<p>a<b" + " c" * 100_000).startswith("a")
    assert html_text.main_text("<p>a &amp; b</p></div></article>" * 20_000).count("\n") == 19_999
    assert time.process_time() - t < 30


def test_extraction_of_a_table(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(i, "u", PAGE) for i in range(60)] + [(7, "u", PAGE), (None, None, None)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == 62 and sum(r.text == "Head line\nFirst para <one> next line.\nSecond bold text." for r in got) == 61


def test_text_classifier_is_trained():
    g = np.random.default_rng(1)
    x = np.stack([np.ones(4000), g.random(4000), g.integers(0, 2, 4000), g.integers(0, 2, 4000), g.random(4000)], 1)
    y = (x[:, 1] - x[:, 4] + 0.3 * x[:, 2] + 0.2 * g.normal(size=4000) > 0).astype(float)
    w = html_text.train_weights(x, y)
    assert w[1] > 0 and w[2] > 0 and w[4] < 0 and (((x @ w) > 0) == y).mean() > 0.85


def test_hidden_blocks_of_an_article_stay():
    page = '<article><p>The first paragraph of the story is here.</p><p hidden>A second paragraph, folded away.</p><div style="display:none" aria-hidden="true"><p>A third one, shown on demand.</p></div></article>'
    assert html_text.main_text(page).count("\n") == 2


# 7 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_a_block, queries_a_block, rerank", [(32_768, 8192, 1024), (700, 40, 64)])
def test_nearest_against_brute_force(spark, monkeypatch, rows_a_block, queries_a_block, rerank):
    monkeypatch.setattr(ann, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", queries_a_block)
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 30)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 30), (5040, [float("nan")] * 30), (5060, [None] * 30), (None, x[0].tolist()), (0, x[0].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(d, d.where("vec_id % 20 = 0"), rerank=rerank).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = np.cumsum(x * x[q], axis=1)[:, -1]
        want = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        hits += len({i for _, i, _ in found} & set(want))
        assert [r for r, *_ in found] == list(range(1, 21)) and all(sc == s[i] for _, i, sc in found)
        if q == 100:
            assert [i for _, i, _ in found] == list(range(101, 121))
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_with_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [1.0, 1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(d, d.where("vec_id = 0")).collect()] == [(0, 1, 1.0)]
    assert ann.nearest(d.limit(0), d).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [1.0, 1.0, 0.0]), (2, [2.0, 1.0]), (20, [1.0, 1.0]), (40, [5.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in ann.nearest(mixed, mixed.where("vec_id % 20 = 0")).collect()) == [(0, 1, 1.0), (20, 2, 3.0)]


# 8 -------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8)))
    texts, y = [], []
    for i in range(1500):
        good = i % 4 != 0
        w = [word() for _ in range(draw.randrange(5, 60))]
        texts.append(" ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w))
        y.append(int(good))
    d = docs(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (3, None)], "doc_id long, quality int")
    w = quality.fit_quality(d, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(d, w).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= quality.THRESHOLD) == (y[i] == 1) for i in held) >= 0.97 * len(held)
    assert 0 <= got[1500] <= 1 and got[1500] == got[1501]
    assert quality.accepted_only(d, w).columns == d.columns


def test_shape_of_a_long_word_is_of_the_whole_word():
    memo = quality.WordHashes()
    x, y, z = (memo[b"a" * 70 + tail] for tail in (b"1", b"B2", b"aa1"))
    assert x[1] != y[1] and x[1] == z[1] and x[0] != z[0]


def plain_ftrl(rows, epochs):
    """Follow-the-regularised-leader as it is written down: one coordinate at a time, no arrays."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            slots, x, y = rows[r]
            w = {k: weight(k) for k in slots.tolist()}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[k] * v for k, v in zip(slots.tolist(), x.tolist()))))))
            for k, v in zip(slots.tolist(), x.tolist()):
                g = (p - y) * v
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / quality.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def test_training_is_the_plain_algorithm():
    g = np.random.default_rng(2)
    rows = []
    for i in range(60):
        slots = np.append(np.unique(g.integers(0, 40, 8)), quality.SLOTS)
        rows.append((slots, np.append(g.random(len(slots) - 1), 1.0), i % 2))
    w, plain = quality.train_ftrl(rows, 3), plain_ftrl(rows, 3)
    assert set(np.flatnonzero(w).tolist()) == {k for k, v in plain.items() if v}
    assert all(w[k] == pytest.approx(v, abs=1e-9) for k, v in plain.items())


def test_scores_are_sparse_products_of_whole_texts(spark):
    g = np.random.default_rng(3)
    w = g.normal(size=quality.SLOTS + 1)
    texts = ["One two two two, THREE 4.", "x", "", None, "long word " * 60_000]
    got = {r.doc_id: r.score for r in quality.score_quality(docs(spark, texts), w).collect()}
    for i, t in enumerate(texts):
        slots, x = quality.counted(t, quality.WordHashes())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[k] * v for k, v in zip(slots.tolist(), x.tolist())))))))
    assert quality.score_quality(docs(spark, []), w).count() == 0


def test_quality_without_labels(spark):
    w = quality.fit_quality(docs(spark, ["a b"]), spark.createDataFrame([], "doc_id long, quality int"))
    assert not w.any() and quality.score_quality(docs(spark, ["a b"]), w).first().score == 0.5


# 9 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


ODD_TEXTS = ["It's we're I'd' 's ''s x'll <|endoftext|>A<|ENDOFTEXT|> Ab \x85 a b ÀÉ á ÅΣ ς 漢字 ½ ² ǅ ﬁ İ ı ß ẞ µ ª º \xad", "ABC\x1cdef\x00\x01 tab\tnl\r\n\x0b\x0c x", "🙂🙂 a🙂b ét́", "!!! ... a.b,c; 3rd 12,5 %%%"]


def test_words_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    draw = random.Random(8)
    alphabet = "abcXYZéèßñÅ0159.,'!%|<>&-_ \n\t漢Σ"
    texts = ODD_TEXTS + ["".join(draw.choice(alphabet) for _ in range(200)) for _ in range(200)] + ["", " ", "a" * 50_000, "word. " * 3000]
    w = token_files.TextIds(tokenizer)
    assert w.cut is not None
    for most in (token_files.PIECES_A_CALL, 7):
        monkeypatch.setattr(token_files, "PIECES_A_CALL", most)
        ids, sizes = w.encode(pa.array(["x", *texts]).slice(1), 1)
        at = 0
        for t, n in zip(texts, sizes):
            assert ids[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]
            at += n
        assert at == len(ids)
    assert w.encode(pa.array([], pa.string()), 1)[0].tolist() == []


def test_latin_letters_are_their_own_normal_form():
    letters = [chr(c) for c in range(0x21, 0x250) if token_files.PLAIN.fullmatch(chr(c))]
    assert all(unicodedata.is_normalized("NFC", a + b) for a in letters for b in "aé\u024f")
    simple = pc.match_substring_regex(pa.array([c.lower() if c.isascii() else c for c in letters]), token_files.SIMPLE).to_pylist()
    assert [c.isalpha() for c in letters] == simple


def test_re_pair_round_trip_and_random_access():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        ids = g.choice([1, 7, 8, 9, 10], size=n, p=[0.05, 0.4, 0.3, 0.2, 0.05]).astype(np.uint32)
        if n == 5000:
            ids[:600] = 7  # overlapping occurrences
        s, r, lengths = token_files.re_pair(ids, 1, 100)
        assert (token_files.expand(s.astype(np.int64), r.astype(np.int64), lengths, 100) == ids).all()
        assert n < 100 or len(s) < 0.8 * n


@pytest.mark.parametrize("bits, most", [(20, 2048), (2, 1)])
def test_re_pair_goes_on_until_no_pair_is_frequent(monkeypatch, bits, most):
    monkeypatch.setattr(token_files, "COUNT_BITS", bits)
    monkeypatch.setattr(token_files, "RULES_A_ROUND", most)
    g = np.random.default_rng(3)
    passage = g.integers(10, 5000, 400)
    ids = np.concatenate([x for _ in range(40) for x in (passage, g.integers(10, 5000, 20), [1])] + [np.tile([7, 8], 100)]).astype(np.uint32)
    s, r, lengths = token_files.re_pair(ids, 1, 10_000)
    pairs, n = np.unique(s[:-1].astype(np.int64) << 32 | s[1:], return_counts=True)
    assert not [x for x, k in zip(pairs.tolist(), n) if k >= token_files.LEAST_COUNT and x >> 32 != 1 and x & 0xFFFFFFFF != 1]
    assert lengths.max() > 16 and len(s) < 0.1 * len(ids)
    assert (token_files.expand(s.astype(np.int64), r.astype(np.int64), lengths, 10_000) == ids).all()


def test_token_files(spark, tokenizer):
    texts = [None, "", *ODD_TEXTS, "same text " * 500, "same text " * 500, "word " * 20_000]
    d = docs(spark, texts).unionByName(spark.createDataFrame([(None, "x", "en", "s", 1, "c", 1)], docs(spark, []).schema)).repartition(3)
    path = scratch(spark, "test-tokens")
    token_files.write_token_files(d, path, token_files.tokenizer_path(), shard_ids=3000)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    start = 2  # the null id comes first: "x" and the end id
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for row in spark.read.schema(token_files.FILE_SCHEMA).parquet(path).collect():
        numbers = np.frombuffer(row.doc_ids, "<i8")
        for k, i in enumerate(numbers):
            if not row.doc_null[k]:
                assert token_files.document_ids(row.asDict(), k).tolist() == tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1]


def test_token_files_of_nothing(spark):
    assert token_files.token_output(docs(spark, []).limit(0)).count() == 0


# 10 ------------------------------------------------------------------------------------------


def test_decontamination_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(docs(spark, []), items).count() == 0
    got = decontaminate.decontaminate(docs(spark, ["a b c", "word " * 200_000 + "a b c"]), items).orderBy("doc_id").collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(3, True), (3, False)]


def brute_contamination(text, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(13, len(v))
        if not m:
            continue
        grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_matches_brute_force(spark):
    draw = random.Random(9)
    vocabulary = ["a", "b", "c", "É", "d9"]
    some = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, some(draw.choice([1, 2, 5, 13, 14, 30]))) for i in range(30)] + [(77, None), (78, "--"), (79, items_text := some(40)), (80, items_text)]
    texts = [some(draw.randrange(0, 60)) for _ in range(150)] + [None, "", items_text.upper(), "x " * 500 + items_text.replace(" ", "... "), "x " * 90_000]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    d = docs(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(d, bench).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_contamination(t, items), t
    tables = decontaminate.benchmark_tables(bench)
    assert sorted(r.doc_id for r in decontaminate.contaminated_only(d, tables, True).collect()) == sorted(i for i, g in got.items() if g[-1])
    assert decontaminate.decontaminate(d, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_by_parts_is_that_of_the_whole_benchmark(spark):
    draw = random.Random(10)
    some = lambda n: " ".join(draw.choice(["a", "b", "c", "É", "d9"]) for _ in range(n))
    long = some(300)
    items = [(i, some(draw.choice([1, 5, 13, 14, 30]))) for i in range(30)] + [(77, None), (78, "--"), (79, long), (80, long), (None, some(20))]
    texts = [some(draw.randrange(0, 60)) for _ in range(100)] + [None, "", long, items[-1][1], "x " * 200 + long[250:420]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts).unionByName(docs(spark, texts[-4:])).unionByName(docs(spark, texts[-3:]).withColumn("doc_id", F.lit(None).cast("long")))
    parts = decontaminate.benchmark_tables(bench, most_bytes=250)
    assert len(parts) > 4 and all(sum(len(" ".join(map(bytes.decode, p))) for t in own for p in t.items) for own in parts)
    order = lambda found: sorted(map(tuple, found.collect()), key=repr)
    assert order(decontaminate.decontaminate(d, bench, most_bytes=250)) == order(decontaminate.decontaminate(d, bench))
    whole = decontaminate.benchmark_tables(bench)
    for keep in (True, False):
        got = decontaminate.contaminated_only(d, parts, keep)
        assert got.columns == d.columns and order(got) == order(decontaminate.contaminated_only(d, whole, keep))


def test_pieces_of_a_long_item_have_each_window_once():
    text = " ".join(f"w{i}" for i in range(500))
    windows = [tuple(w[i : i + 13]) for p in decontaminate.pieces(text, 13, 300) for w in [p.split()] for i in range(len(w) - 12)]
    words = text.split()
    assert windows == [tuple(words[i : i + 13]) for i in range(488)] and list(decontaminate.pieces("a b", 13, 1)) == ["a b"]


def test_sketches_of_long_unrelated_texts_differ():
    g = np.random.default_rng(4)
    a, b, c = (g.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(3))
    near = np.concatenate([a[:2850], c[:150]])  # 0.905
    x, y, z = (near_dups.sketch_matrix([near_dups.sketch_of(near_dups.signature(np.sort(s)))]) for s in (a, b, near))
    assert (x == y).mean() < 0.05 and (x == z).mean() > 0.8
    assert len(np.unique(x)) > 80

"""Operators 4, 5, 6, 7, 8 and the pipeline: brute force, held-out accuracy, odd rows."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from conftest import SF0001
from edge import TEXTS, documents, labels
from lexiflow.llm import bm25, components, html_extract, near_dup, sharding, toxicity
from lexiflow.session import Scratch


def lower(t):
    return (t or "").encode().lower().split()


def sample(spark, n=200):
    return spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").limit(n)


# 8 ---------------------------------------------------------------------------------------------

def shingles(t, k):
    w = lower(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components_brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                top[q] = p
    return {i: find(i) for i in top}


def near_copies(seed, groups, size, words=60, star=False):
    """Groups of texts: copies of a base text with a word changed here and there."""
    rng, rows, i = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for n in range(size):
            t = list(base)
            # in a star the copies differ more from each other than from the base
            for p in (rng.sample(range(words), 1) if star and n else [rng.randrange(words)] * (n % 3)):
                t[p] = f"x{rng.randint(0, 10 ** 6)}"
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    return [(n, t) for n, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("rows", [
    near_copies(1, 25, 6), near_copies(2, 2, 70), near_copies(3, 3, 40, words=43, star=True),
    [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(0, 300, 3)],      # a chain
])
def test_near_duplicates_equal_brute_force(spark, rows):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    want = components_brute(rows, 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id], 4))
               for r in got)


def test_near_duplicates_within_a_template_family(spark):
    """240 texts share a template at 0.71; each has one partner at 0.85 and no other link.
    The forest is so shallow that its sorted orders alone miss most of them."""
    template = [f"t{i}" for i in range(150)]
    rows = [(g + 120 * j, " ".join(template + [f"g{g}x{i}" for i in range(16)] + [f"g{g}y{j}x{i}" for i in range(14)]))
            for g in range(120) for j in (0, 1)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, trees=4,
                                   depth=3, min_depth=2, near=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 120 for i, _ in rows} == components_brute(rows, 4)


def test_near_duplicates_odd_rows(spark):
    docs = documents(spark)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[7].component_id == 6 and by[5].component_id == 4 and not by[7].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 3))
    assert all(r.kept for r in got if r.doc_id is None)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 8, 9, 10, 100, None, None])
    assert near_dup.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()
    want = {i: 10 for i in range(10, 61)} | {i: 1000 for i in range(1000, 1200)}
    assert {r.u: r.v for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_in_one_and_in_many_partitions(spark, monkeypatch, few):
    from lexiflow.session import Scratch as Owner
    monkeypatch.setattr(components, "FEW", few)
    plans, cut = [], Owner.cut
    monkeypatch.setattr(Owner, "cut", lambda self, df, name="table": (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(self, df, name))[1])
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"), Owner(spark)).collect()
    top = {i: i for i in range(400)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert {r.u: r.v for r in got} == {i: find(i) for i in linked} and len(got) == len(linked)
    assert any("Exchange" in p for p in plans) == (few == 0)


# 4 ---------------------------------------------------------------------------------------------

def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sharding.shard_rows(docs).collect()
    loads, places, shard_of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
        shard_of_text[text[r.doc_id]].add(r.shard)
    assert len(rows) == len(text) and set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(len(s) == 1 for s in shard_of_text.values())


def test_hot_text_is_split(spark):
    rows = [(i, "the same words " * 20) for i in range(900)] + [(i, f"other {i} " * 9) for i in range(900, 1800)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.05 * sum(loads.values()) / 8


def test_growing_moves_slots_into_the_new_shard_only():
    rng = random.Random(2)
    weights = [rng.randint(1, 1000) for _ in range(4096)]
    old = sharding.SlotMap(4096, 8, sharding.assign(weights, 8), weights)
    new = old.grown(9)
    assert new.version == 2 and all(b in (a, 8) for a, b in zip(old.shard, new.shard))
    assert max(new.loads()) - min(new.loads()) <= 0.02 * sum(weights) / 9
    assert len(new.shard) == 4096


def test_sharding_odd_rows(spark):
    rows = sharding.shard_rows(documents(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.size for r in rows if r.doc_id in (1, 2)} == {1}
    assert sharding.shard_rows(documents(spark, [])).collect() == []


# 5 ---------------------------------------------------------------------------------------------

def bm25_brute(rows, queries, k=10, k1=1.2, b=0.75):
    docs = [(i, Counter(lower(t))) for i, t in rows]
    df = Counter(w for _, c in docs for w in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    out = {}
    for q, text in queries:
        hits = {}
        for i, c in docs:
            norm = k1 * (1 - b + b * sum(c.values()) / mean)
            s = sum(x * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + norm)
                    for w, x in Counter(lower(text)).items() if w in c)
            if s > 0 and i is not None:
                hits[i] = max(hits.get(i, 0), round(s, bm25.DIGITS))
        out[q] = sorted((-s, i) for i, s in hits.items())[:k]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 16])
def test_search_equals_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(bm25, "SHARD_ROWS", shard_rows)
    docs = sample(spark).repartition(5, "doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    queries = [r for r in rows if r[0] % 10 == 0] + [(-1, "the of and"), (-2, "zzzz"), (-3, None)]
    got = bm25.top_k(docs, spark.createDataFrame(queries, "doc_id long, text string"), query_block=9, block=8).collect()
    want = bm25_brute(rows, queries)
    for q, hits in want.items():
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.doc_id for r in found] == [i for _, i in hits]
        assert all(abs(r.score + s) <= 2e-6 for r, (s, _) in zip(found, hits))


@pytest.mark.parametrize("shard_rows, first_part", [(4096, 16), (4, 1)])
def test_search_counts_a_repeated_id_once(spark, monkeypatch, shard_rows, first_part):
    monkeypatch.setattr(bm25, "SHARD_ROWS", shard_rows)
    rows = [(1, "apple apple apple")] * 11 + [(i, "apple " + "pear " * i) for i in range(2, 20)] + [(5, "apple fig")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = [(-1, "apple")]
    got = bm25.top_k(docs, spark.createDataFrame(queries, "doc_id long, text string"), first_part=first_part).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in bm25_brute(rows, queries)[-1]]


def test_search_in_blocks_of_few_words(spark):
    docs = sample(spark, 60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = bm25.top_k(docs, docs.where("doc_id % 5 = 0"), query_words=700).collect()
    for q, hits in bm25_brute(rows, [r for r in rows if r[0] % 5 == 0]).items():
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [
            i for _, i in hits]


@pytest.mark.parametrize("dense", [0, 3, 512])
def test_shard_search_with_and_without_matrix_rows(monkeypatch, dense):
    import pyarrow as pa
    monkeypatch.setattr(bm25, "DENSE", dense)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(1, 60)))) for i in range(300)]
    made = bm25.Postings()
    for i, t in rows:
        made.add(i, lower(t))
    df = Counter(w for _, t in rows for w in set(lower(t)))
    shard = bm25.Shard(made.record(pa.int64()).to_pylist()[0], sum(len(lower(t)) for _, t in rows) / 300, 1.2, 0.75, 16)
    assert len(shard.dense) <= dense
    queries = rows[::10] + [(-1, "none of these")]
    asked = [sorted((w, x * math.log1p((300 - df[w] + 0.5) / (df[w] + 0.5))) for w, x in Counter(lower(t)).items())
             for _, t in queries]
    ready = shard.batch([([w for w, _ in q], np.array([x for _, x in q])) for q in asked])
    for (q, hits), query in zip(bm25_brute(rows, queries).items(), ready, strict=True):
        least = round(-hits[-1][0], bm25.DIGITS) - 1e-6 if len(hits) == 10 else 0.0
        for floor in (0.0, least):
            found = shard.search(*query, floor, 10)
            assert [i for _, i in found] == [i for _, i in hits]
            assert all(abs(a - b) <= 2e-6 for (a, _), (b, _) in zip(found, hits))
    assert shard.search(*ready[0], 1e6, 10) == []


def test_index_holds_no_word_lists():
    import tracemalloc
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 2000)}" for _ in range(500)) for _ in range(400)]
    tracemalloc.start()
    made = bm25.Postings()
    for i, t in enumerate(texts):
        made.add(i, lower(t))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 16 * sum(len(lower(t)) for t in texts)       # a list of words takes over 40 bytes each


def test_index_rows_stay_small(spark):
    docs = spark.range(5000, numPartitions=1).selectExpr(
        "id", "array_join(transform(sequence(0, 149), j -> concat('w', cast(pmod(xxhash64(id, j), 3000) as string))), ' ') text")
    sizes = bm25.build_index(docs).selectExpr(
        "size(ids) n", "length(lengths) + length(terms) + length(starts) + length(docs) + length(tfs) bytes").collect()
    assert sum(r.n for r in sizes) == 5000
    assert max(r.bytes for r in sizes) < 2 << 20        # a row passes whole through the executors and their workers


def test_shard_keeps_counts_of_any_size():
    import pyarrow as pa
    rows = [(i, "common " * (1 + i % 3) + f"only{i}") for i in range(300)] + [(300, "common " * 300 + "only7"),
                                                                         (301, "common " * 70000 + "only9 only9")]
    for used in (rows[:3], rows[:300], rows[:301], rows):
        made = bm25.Postings()
        for i, t in used:
            made.add(i, lower(t))
        row = made.record(pa.int64()).to_pylist()[0]
        mean = sum(len(lower(t)) for _, t in used) / len(used)
        shard = bm25.Shard(row, mean, 1.2, 0.75, 16)
        for word, t in shard.number.items():
            of = slice(shard.starts[t], shard.starts[t + 1])
            want = {i: n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(lower(x)) / mean)) for i, x in used
                    if (n := lower(x).count(word))}
            assert shard.docs[of].tolist() == list(want)
            assert np.allclose(shard.impact[of], list(want.values()), rtol=1e-12)
    nothing = bm25.Postings()
    nothing.add(1, [])
    assert bm25.Shard(nothing.record(pa.int64()).to_pylist()[0], 0.0, 1.2, 0.75, 16).starts.tolist() == [0]


def test_search_odd_rows(spark):
    docs = documents(spark)
    got = bm25.top_k(docs, docs).collect()
    assert all(r.doc_id is not None for r in got)
    assert {r.query_id for r in got} == {4, 5, 6, 7, 8, 9, 10, 100}
    assert len({(r.query_id, r.doc_id) for r in got}) == len(got)
    empty = documents(spark, [])
    assert bm25.top_k(empty, docs).collect() == [] and bm25.top_k(docs, empty).collect() == []


# 6 ---------------------------------------------------------------------------------------------

def test_toxicity_finds_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, lab).selectExpr("doc_id", "toxicity.*").join(lab, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    found = [r for r in held if r.predicted]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.toxic for r in found) >= 0.95 * len(found)
    assert sum(r.toxic for r in found) >= 0.5 * sum(r.toxic for r in held)


def test_toxicity_learns_no_held_out_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a = toxicity.fit_toxicity(docs, lab)
    b = toxicity.fit_toxicity(docs, lab.selectExpr(
        "doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end toxic"))
    assert (a.unigram, a.bigram, tuple(a.curve)) == (b.unigram, b.bigram, tuple(b.curve))


def test_discount_keeps_the_backoff_for_rare_expressions():
    import numpy as np
    r = toxicity._discounted(np.array([1.0, 3.0, 80.0, 0.0]), np.array([0.0, 30.0, 0.0, 90.0]), np.full(4, 0.1), 3.5)
    assert r[0] == 0 and r[1] == 0 and r[2] > 2 and r[3] <= 0


def test_toxicity_odd_rows(spark):
    for lab in (labels(spark), labels(spark).limit(0)):
        rows = toxicity.toxicity(documents(spark), lab).selectExpr("doc_id", "toxicity.*").collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.keep_ordinary(documents(spark), lab).columns == documents(spark).columns
    assert toxicity.toxicity(documents(spark, []), labels(spark)).count() == 0


# 7 ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t {0}</title><style>p{{}}</style><script>var x="</p>";</script></head>
<body><div class="cookie-notice">We use cookies</div><header>Site</header><nav><ul><li><a>Home {0}</a></ul></nav>
<div class="wrap"><div class="sidebar">Side {0}</div><div class="post"><h1>Title {0}</h1><p>First&nbsp;{0}   &amp; more
<br>line<p>Second <b>bold {0}</p><table><tr><td>cell {0}<td>two</table></div></div>
<div id="comments"><p>Reader {0}</p></div><form><input><button>Go</button></form><footer>Legal {0}</footer>"""


def test_wrapper_and_text():
    pages = [PAGE.format(f"n{i} " * (i + 1)) for i in range(4)]
    w = html_extract.induce(pages)
    assert w["path"] == "/html/body/div.wrap/div.post"
    got = html_extract.extract(PAGE.format("n7"), w)
    assert got == "Title n7\n\nFirst n7 & more line\n\nSecond bold n7\n\ncell n7\n\ntwo"


def test_constant_texts_are_template():
    page = "<html><body><div><p>{0}</p></div><section>Follow us on this site</section><div><p>{1}</p></div>"
    rng = random.Random(1)
    pages = [page.format(" ".join(f"a{rng.random()}" for _ in range(9)), f"b{i}") for i in range(4)]
    w = html_extract.induce(pages)
    assert ["/html/body/section", "Follow us on this site"] in [list(c) for c in w["constant"]]


def test_title_and_lead_beside_the_body_stay():
    pages = [f"<body><div class=post><h1>Title {i}</h1><p class=lead>Lead {i}.</p>"
             f"<div class=entry>{''.join(f'<p>Body {i} {j} of many words.</p>' for j in range(40))}</div>"
             + (f"<div class=end>Only here {i}</div>" if i == 4 else "") + "</div>"
             + "<div class=deep>" + "<div>" * 80 + f"Deep {i}" + "</div>" * 81 + "</body>" for i in range(6)]
    wrapper = html_extract.induce(pages)
    for i, page in enumerate(pages):
        got = html_extract.extract(page, wrapper)
        assert all(t in got for t in (f"Title {i}", f"Lead {i}.", f"Body {i} 39 of many words.", f"Deep {i}"))
        assert ("Only here 4" in got) == (i == 4)
    shallow = [p.split("<div class=deep>")[0] for p in pages]
    assert html_extract.induce(shallow)["path"].endswith("/div.post")


def test_tree_matching_counts():
    a, b = (html_extract.fold(html_extract.parse(h)) for h in
            ("<div><h1>a</h1><p>b</p><ul><li>c</li></ul></div>", "<div><h1>x</h1><table></table><p>y</p></div>"))
    assert html_extract.tree_match(a, b)[0] == 4      # root, div, h1, p


def test_pages_of_the_table(spark):
    import html as H
    import re
    pages = spark.read.parquet(f"{SF0001}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S).group(1)
        parts = re.sub(r"<[^>]*>", "", re.sub("<br>", " ", re.sub(r"</?(h1|p)>", "\0", inner))).split("\0")
        want = "\n\n".join(x for x in (" ".join(H.unescape(y).split()) for y in parts) if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_pages_odd_rows(spark):
    rows = [(1, "http://a.b/x", None), (2, None, ""), (None, "http://a.b/y", "<p>x"), (3, "no url", "plain & text"),
            (4, "http://a.b/z", "<div>" * 3000 + "deep"), (5, "http://a.b/z", "<p>" + "long " * 100_000),
            (5, "http://a.b/z", "<p>" + "long " * 100_000), (6, "http://a.b/<", "<<<&&& <a href='x <b>q</"),
            (7, "http://C.d", "<article><p>one<article><p>two</article></article><p>out")]
    docs = spark.createDataFrame([(*r, "t", "w") for r in rows],
                                 "page_id long, url string, html string, text string, wrapper string")
    got = html_extract.extract_main_text(docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "plain & text" and by[4] == "deep" and by[None] == "x"
    assert by[5] == ("long " * 100_000).strip() and by[7] == "one\n\ntwo"
    assert html_extract.extract_main_text(docs.limit(0)).collect() == []


# pipeline --------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, columns = Scratch(spark), docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "minhash_near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = scratch.cut(stage(spark, docs, sf), name)
        assert kept.columns == columns and 0 < kept.count() <= docs.count()
        if name == "minhash_near_dedup":
            before = [(r.doc_id, r.text) for r in docs.collect()]
            want = {i for i, c in components_brute(before, 5).items() if i == c}
            assert {r.doc_id for r in kept.collect()} == want
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_and_no_rows(spark, tmp_dir):
    for rows in (TEXTS, []):
        path = f"{tmp_dir}/{len(rows)}"
        documents(spark, rows).write.parquet(f"{path}/documents.parquet")
        labels(spark).write.parquet(f"{path}/labels.parquet")
        assert corpus_pipeline.run(spark, path).count() >= 0

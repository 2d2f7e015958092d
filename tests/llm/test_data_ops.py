"""HTML, sharding, media, archive, near-duplicates, components and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from segspark.llm import components, gif, html_extract, sharding, simhash, warc_store
from segspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. Ut enim ad minim veniam, quis nostrud."
EDGES = [None, "", " \n", "a", "é😀", "the cat " * 5000, "x" * 40000, "same words in here now", "same words in here now"]
SCHEMA = "doc_id long, text string, lang string, key string, size string, component_id string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div id=top><a href=/>Home</a></div><div class='wrap has-sidebar'><div class=content><h1>T &amp; x</h1><p>{P}<p>Short.<ul><li>One<li>Two</ul></div><div class=sidebar><p>{P}</div></div><div id=comments><p>{P}</div>", f"T & x\n{P}\nShort.\nOne\nTwo"),
        (f"<body><header><p>{P}</header><main><h1>Hi</h1><p>{P}</p><aside>{P}</aside><section class=userComments><p>{P}</section><form>{P}</form><pre>code   x</pre></main>", f"Hi\n{P}\ncode x"),
        (f"<article><p>{P}</p><script>if (a<b) '</p>'</script><style>x</style><p>a<br>b</p></article>", f"{P}\na b"),
        (None, ""),
        ("", ""),
        ("plain &lt;text", "plain <text"),
        ("<!--" * 2000, ""),
        ("<div>" * 3000 + "x", "x"),
        ('<p a="' * 2000, ""),
        ("<p>Before <svg/>TAIL here</p>", "Before TAIL here"),
        (f"<article><h1>T</h1><math/><p>{P}</p></article>", f"T\n{P}"),
        (f"<div class='article-with-comments'><p>{P}</p></div>", P),
        (f"<div class='recommended-reading'><p>{P}</p><p>{P}</p></div>", f"{P}\n{P}"),
        (f"<body><div id='social-history'><p>{P}</p><p>{P}</p></div><div>Other</div>", f"{P}\n{P}"),
        (f"<article><p>{P}<p>{P}<p>short<div class=comments><p>{P}<p>{P}<p>{P}<p>{P}</div></article>", f"{P}\n{P}\nshort"),
        ("<p>a <span class=notice>b</span> c <span hidden>d</span>", "a b c"),
        ("<div>" * 600 + "<nav>MENU</nav><p>text", "text"),
        ("<script src=x /><p>hello", "hello"),
    ],
)
def test_html(page, want):
    assert html_extract.extract(page) == want


def test_html_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_extract.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        art = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        import html as h

        want = re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", art.replace("</b>", "")))).strip()
        assert re.sub(r"\s+", " ", r["text"]).strip() == want and r["n_chars"] == len(r["text"])


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(table(spark, EDGES + ["hot"] * 300).selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = sharding.digest(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    total, biggest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        by.setdefault(r["shard"], []).append(r)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and set(by) <= set(range(24))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 24) <= biggest
    assert sharding.digest(table(spark, [])).count() == 0


def test_lzw_and_gif_round_trips():
    rng = random.Random(1)
    for data in (b"", b"a", b"a" * 9000, bytes(rng.randrange(256) for _ in range(30000)), b"abcab" * 20000):
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data
    payload = bytes(rng.randrange(256) for _ in range(576 * 150))
    data = gif.encode(payload)
    w, h, found = gif.decode(data)
    assert (w, h, len(found), [f.height for f in found]) == (576, 64, 3, [64, 64, 22]) and gif.samples(data) == payload
    for bad in (b"", b"GIF89a", data[:900], data[:-1]):
        with pytest.raises(ValueError):
            gif.decode(bad)


def test_gif_disposal_and_transparency():
    red, blue = np.array([[255, 0, 0], [0, 0, 255]], np.uint8), None
    f = lambda samples, **k: gif.Frame(0, 0, 2, 1, red, bytes(samples), **k)
    shown = [c[0, :, [0, 2, 3]].T.tolist() for c in gif.composed(2, 1, [f([0, 0]), f([1, 0], transparent=0, disposal=3), f([0, 1], transparent=0, disposal=2), f([1, 1], transparent=1)])]
    assert blue is None and shown == [[[255, 0, 255]] * 2, [[0, 255, 255], [255, 0, 255]], [[255, 0, 255], [0, 255, 255]], [[0, 0, 0], [0, 0, 0]]]


def test_media_query(spark):
    rows = {r["doc_id"]: r for r in gif.digest(table(spark, EDGES)).collect()}
    for i, t in enumerate(EDGES):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[7]["feature"] == rows[8]["feature"] and rows[0]["media_sha256"] == rows[1]["media_sha256"]
    assert gif.frames(gif.media(table(spark, EDGES))).where("doc_id = 3").first()["duration_ms"] == 100


def test_archive(spark, tmp_path):
    big = "<p>" + "é" * 900
    htmls = [big, "small", big, None, "small", big, big]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, 0) for i, h in enumerate(htmls)], "page_id long, url string, html string, address long")
    path = warc_store.write(pages, f"file://{tmp_path}/w")
    rows = {r["page_id"]: r for r in warc_store.read_back(spark, path).collect()}
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        again = h == big and i != 6
        assert tuple(rows[i]) == (i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 6 if again else None)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = {r["page_id"]: bytes(r["record"]) for r in warc_store.reconstruct(spark, path).collect()}
    assert records[6].endswith(big.encode() + b"\r\n\r\n") and big.encode() not in records[0] and records[0].startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n")
    for record in records.values():
        head, _, rest = record.partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
    assert warc_store.digest(pages.limit(0)).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("per_task", [1 << 12, 4])
def test_simhash_equals_brute_force(spark, per_task):
    rng = random.Random(6)
    texts = list(EDGES)
    for _ in range(12):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 50)) for _ in range(80)]
        texts.append(" ".join(words))
        for _ in range(4):
            words[rng.randrange(80)] = "changed"
            texts.append(" ".join(words))
    marks = [fingerprint(t) for t in texts]
    want = groups(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    rows = simhash.components_of(table(spark, texts), per_task=per_task).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["bits"] % (1 << 64) for r in rows} == dict(enumerate(marks))
    assert simhash.digest(table(spark, [])).count() == 0


def test_near_duplicates_and_dense_groups(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(15):
        words = [word() for _ in range(200)]
        texts.append(" ".join(words))
        for k in (60, 140):
            words = list(words)
            words[k] = word()
        texts.append(" ".join(words))
    first = texts[0].split()
    texts += [" ".join(first[:100] + [word()] + first[101:]) for _ in range(120)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, texts), block=2000).collect()}
    assert all(got[i] == i - i % 2 for i in range(30)) and all(got[i] == 0 for i in range(30, 150))


def _similar(rng, base, share):
    """Words whose five-word shingles have about the Jaccard similarity `share` with those of base: a new tail."""
    keep = round(2 * share / (1 + share) * len(base))
    return base[:keep] + [f"w{rng.randrange(10**9)}" for _ in base[keep:]]


def test_near_duplicates_are_verified(spark):
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(10**9)}" for _ in range(300)] for _ in range(40)]
    texts = [" ".join(words) for base in bases for words in (base, _similar(rng, base, 0.74), _similar(rng, base, 0.84))]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    want = groups(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])])
    got = simhash.near_duplicates(table(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_copies_around_the_threshold_equal_brute_force(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(120)] = f"w{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    texts += texts[40:44]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    want = groups(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])])
    assert 10 < len(set(want.values())) < 90
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(spark, texts), block=3000).collect()} == want


def test_candidates_at_the_threshold_do_not_depend_on_other_rows():
    rng = np.random.default_rng(9)
    shared = []
    for _ in range(4000):
        hashes = rng.integers(1 << 63, size=200, dtype=np.uint64) * np.uint64(2)
        other = np.concatenate([hashes[:178], rng.integers(1 << 63, size=22, dtype=np.uint64)])
        a, b = simhash.band_keys(np.stack([simhash.minima(hashes), simhash.minima(other)]))
        shared.append(int((a == b).sum()))
    assert min(shared) > 0 and abs(np.mean(shared) - simhash.BANDS * (178 / 222) ** simhash.ROWS) < 0.2


def test_sieve_misses_no_key(spark):
    from segspark.llm.common import sieved

    rows = spark.range(3000).selectExpr("xxhash64(id) AS k", "id AS sieve_bits", "id % 7 = 0 AS wanted")
    edge = spark.createDataFrame([(k, 0, True) for k in (0, 1, 32768, 32769, -1, (1 << 26) - 1, 2**63 - 1, -(2**63))], rows.schema)
    rows = rows.unionByName(edge)
    got = sieved(rows, rows.where("wanted").select("k"), "k", "hit").collect()
    assert len(got) == 3008 and set(got[0].asDict()) == {"k", "sieve_bits", "wanted", "hit"}
    assert all(r.hit for r in got if r.wanted) and sum(r.hit and not r.wanted for r in got) < 20
    assert not any(r.hit for r in sieved(rows, rows.where("false").select("k"), "k", "hit").collect())


def test_dedup_keeps_a_row_of_each_group(spark):
    rng = random.Random(10)
    a, b, c = ([f"w{rng.randrange(10**9)}" for _ in range(100)] for _ in range(3))
    rows = [(1, a), (1, b), (2, b[:-2] + ["x", "y"]), (None, a[:-1] + ["z"]), (None, c), (None, c[:-1] + ["z"]), (None, c), (3, a)]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.dedup(spark, docs, "").collect()
    kept = {(r["doc_id"], r["text"].split()[0]) for r in got}
    assert len(got) == 3 and kept == {(1, a[0]), (1, b[0]), (None, c[0])}


@pytest.mark.parametrize("per_task", [1 << 12, 4])
def test_trie_pairs_span_the_groups_within_the_budget(spark, per_task):
    rng = random.Random(13)
    rows = [(i, bits, n) for i, bits, n in enumerate_marks(rng)]
    pairs = [(r["a"], r["b"]) for r in simhash._trie_pairs(spark.createDataFrame(rows, "id long, bits long, size int"), per_task=per_task).collect()]
    mark = {i: bits % (1 << 64) for i, bits, n in rows if n}
    want = groups(mark, [(i, j) for i in mark for j in mark if j < i and (mark[i] ^ mark[j]).bit_count() <= simhash.BUDGET])
    assert all(a < b for a, b in pairs) and len(pairs) < 2 * len(mark)
    assert groups(mark, pairs) == want and 20 < len(set(want.values())) < len(mark) - 40


def enumerate_marks(rng):
    """(id, bits, size): some equal fingerprints, some within the budget, some just beyond, some of empty sets."""
    found = []
    for _ in range(30):
        bits = rng.getrandbits(64)
        for flips in (0, 0, 1, 2, 3, 4):
            near = bits
            for at in rng.sample(range(64), flips):
                near ^= 1 << at
            found.append((len(found), near - (1 << 64) if near >> 63 else near, 5))
    return [*found, (len(found), 0, 0), (len(found) + 1, 0, 0)]


def test_dedup_takes_its_first_pairs_from_the_trie(spark, monkeypatch):
    rng, seen = random.Random(14), []
    base = [f"w{rng.randrange(10**9)}" for _ in range(2000)]
    texts = [" ".join(base), " ".join(base[:-1] + ["z"]), " ".join(f"w{rng.randrange(10**9)}" for _ in range(300)), ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    forests = simhash._forests

    def spy(rows, *more):
        seen.append({r["key"] % (1 << 64) for r in rows.collect()})
        return forests(rows, *more)

    monkeypatch.setattr(simhash, "_forests", spy)
    # Without keys of minima, all pairs are the trie's.
    posts = simhash._shingle_sets
    monkeypatch.setattr(simhash, "_shingle_sets", lambda *a: posts(*a).withColumn("bands", F.expr("cast(array() as array<bigint>)")))
    got = {r["doc_id"] for r in corpus_pipeline.dedup(spark, docs, "").collect()}
    assert seen == [{int(simhash.fingerprint(np.unique(simhash.shingle_hashes(t, 5)))[0]) for t in texts[:3]}]
    assert got == {0, 2, 3}


def test_components_of_a_hub_and_a_chain(spark):
    links = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in groups({x for a, b in links if a != b for x in (a, b)}, links).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = bench.first()["text"]
    base = docs.first()["text"]
    extra = [(90001, base), (90002, "intro words here " + leak), (90003, "!!! 123"), (90004, "write to someone.real@example.org or call today please"), (90005, None)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "x", 1) for i, t in extra], docs.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = rows, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in at.collect()}
        assert name == "tokens" or at.columns == docs.columns
    assert not {90003, 90005} & seen["language"] and 90001 in seen["language"]
    assert 90001 not in seen["dedup"] and 90002 in seen["dedup"]
    assert 90002 not in seen["decontaminate"] and 90004 in seen["pii"]
    assert "[EMAIL]" in spark.read.parquet(f"{tmp_path}/pii").where("doc_id = 90004").first()["text"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["tokens"])


def test_each_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)

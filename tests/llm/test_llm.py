import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changelens.llm import bpe, decontaminate, exact_dedup, lm, pii, quality, shingle_join, toxicity, url_filter, warc

DOCS = "doc_id long, text string, keep_id string, n string, h string"


def docs(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


ODD = [(1, "a b c d e"), (2, "a  b c d\te"), (3, None), (4, ""), (5, "  \n"), (6, "x" * 50_000 + " y" * 3000), (6, "x" * 50_000 + " y" * 3000), (None, "lonely text here"), (8, "ü ß"), (9, "word")]


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.duplicates(docs(spark, ODD)).collect()}
    assert len(exact_dedup.duplicates(docs(spark, ODD)).collect()) == len(ODD)
    assert got[1].keep_id == 2 and got[2].kept and got[2].group_size == 2 and not got[1].kept
    assert got[3].keep_id == 5 and got[3].group_size == 3
    assert got[8].text_sha256 == hashlib.sha256("ü ß".encode()).hexdigest()
    assert exact_dedup.duplicates(docs(spark, [])).count() == 0


def test_deduplicate_leaves_one_of_repeated_rows(spark):
    rows = [*ODD, (None, "lonely text here"), (None, "lonelytext here"), (9, "word"), (9, " word "), (9, "other"), *[(7, "hot row")] * 300]
    got = exact_dedup.deduplicate(docs(spark, rows).repartition(6))
    assert got.columns == ["doc_id", "text", "keep_id", "n", "h"]
    want = [(2, "a  b c d\te"), (5, "  \n"), (6, ODD[5][1]), (None, "lonely text here"), ODD[8], (9, " word "), (9, "other"), (7, "hot row")]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0


def test_exact_dedup_survives_colliding_identifiers(spark):
    rows = [(i, f"{i % 7} " + "some words that fill chunks " * (20 + i % 5)) for i in range(60)]
    want = {r.doc_id: r.keep_id for r in exact_dedup.duplicates(docs(spark, rows)).collect()}
    few = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    assert {r.doc_id: r.keep_id for r in exact_dedup.duplicates(docs(spark, rows), identify=few).collect()} == want


def test_pseudonyms(spark):
    rows = [(1, "card 4041894974608795 on 1985-03-07"), (2, "4041-8949-7460-8795, 999.1.1.1, 30.02.2001"), (3, None), (4, ""), (5, "no data")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, rows), key="k").collect()}
    card = re.search(r"\d{16}", got[1])[0]
    assert card != "4041894974608795" and re.sub(r"\D", "", got[2].split(",")[0]) == card
    assert "1985-03-07" not in got[1] and got[2].endswith("999.1.1.1, 30.02.2001")
    assert (got[3], got[4], got[5]) == (None, "", "no data")
    total = sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(card))))
    assert total % 10 == 0


def test_pseudonyms_are_bijective(spark):
    values = spark.range(3000).select(F.concat(F.lit("call 2"), F.lpad(F.col("id").cast("string"), 2, "0").substr(1, 2), F.lit("-255-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text")).distinct()
    assert pii.pseudonymise(values).select("text").distinct().count() == values.count()


def test_pseudonyms_of_any_area_code(spark):
    numbers = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(017) 155-7713", "017-555-7713", "+7 (495) 123-4567", "+4930123456", "+49 30 1234567", "+44 (0)20 7946 0958", "+12125551234", "+353 1 234 5678"]
    rows = [(i, f"call {n} 1985-03-07, 10.1.2.3") for i, n in enumerate(numbers)]
    for r in pii.pseudonymise(docs(spark, rows), key="k").collect():
        number = numbers[r.doc_id]
        assert len(r.found) == 3 and r.found[0] == number and r.given[0] != number
        assert re.sub(r"\d", "d", r.given[0]) == re.sub(r"\d", "d", number) and r.text.startswith(f"call {r.given[0]} ")
    plain = ["+1 (212) 555-1234", "212-555-1234", "+12125551234"]
    given = [re.sub(r"\D", "", r.given[0])[-10:] for r in pii.pseudonymise(docs(spark, list(enumerate(plain))), key="k").collect()]
    assert len(set(given)) == 1


def test_pseudonyms_of_area_codes_are_bijective(spark):
    values = spark.range(1000).select(F.concat(F.lit("+1 ("), F.lpad(F.col("id").cast("string"), 3, "0"), F.lit(") 555-0123")).alias("text"))
    got = pii.pseudonymise(values)
    assert got.where("given[0] = found[0]").count() == 0 and got.select("text").distinct().count() == 1000


def test_every_number_of_the_table_changes(spark):
    shape = r"\+\d \(\d{3}\) \d{3}-\d{4}"
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("text").rlike(shape))
    rows = pii.pseudonymise(texts.select("doc_id", "text")).collect()
    before = {r.doc_id: re.findall(shape, r.text) for r in texts.select("doc_id", "text").collect()}
    assert sum(map(len, before.values())) == 159
    assert [(r.doc_id, n) for r in rows for n in before[r.doc_id] if n in r.text] == []


def luhn(number):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", number))))) % 10 == 0


def test_pseudonyms_of_cards_need_their_check_digit(spark):
    cards = ["4041894974608795", "2221000000000009", "9807915762804492", "4222222222222", "378282246310005", "3782 822463 10005", "4041-8949-7460-8795", "6304000000000000000"]
    cards = [c for c in cards if luhn(c)]
    assert len(cards) >= 6 and any(c[0] == "2" for c in cards)
    frames = ["no,{}", "no-{}", "end.{}", "{},5", "{} 12 apples", "12 {}", "12 34 {}", "{} 1985-03-07", "{} 30.02.2001", "{} 212-555-1234", "{} {}", "({})"]
    rows = [(i * 100 + k, f.format(c, c)) for i, c in enumerate(cards) for k, f in enumerate(frames)]
    want = dict(rows)
    given = {}
    for r in pii.pseudonymise(docs(spark, rows), key="k").collect():
        card = cards[r.doc_id // 100]
        shape = re.escape(frames[r.doc_id % 100]).replace(r"\{\}", f"({re.sub('[0-9]', '[0-9]', card)})").replace(r"1985\-03\-07", r"\d{4}-\d\d-\d\d").replace(r"212\-555\-1234", r"\d{3}-\d{3}-\d{4}")
        got = re.fullmatch(shape, r.text)
        assert got and card not in r.text and all(map(luhn, got.groups())), (want[r.doc_id], r.text)
        given.setdefault(card, set()).update(got.groups())
    assert all(len(x) == 1 for x in given.values())
    wrong = [(1, "4041894974608796"), (2, "4041 8949 7460 8796"), (3, "0.4041894974608795"), (4, "404189497460"), (5, "40418949746087954041")]
    assert {r.doc_id: r.text for r in pii.pseudonymise(docs(spark, wrong), key="k").collect()} == dict(wrong)


def test_url_rules(spark):
    urls = [(1, "http://A.Example.org/es/1"), (2, "https://x.example.org/en/1?a"), (3, "https://example.org/en/2"), (4, "http://b.com/fr/"), (5, "http://b.com/de/x#y"), (6, "http://org"), (7, None), (8, "no scheme"), (9, "http://b.net/fr/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][2] is None and got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None)
    assert url_filter.judge(pages.where("false")).count() == 0


@pytest.mark.parametrize("block_bytes", [64, 6 << 20])
def test_bpe(spark, block_bytes):
    from tokenizers import Tokenizer

    rows = [*ODD, (20, "a<|endoftext|> b   c\x1c d!\n\n\nIt's 12345"), (21, "tail  ")]
    tool = Tokenizer.from_file(bpe.default_file())
    got = {(r.doc_id, r.decoded): r.ids for r in bpe.decode(bpe.encode(docs(spark, rows), block_bytes=block_bytes)).collect()}
    assert got == {(i, tool.decode(e, skip_special_tokens=False)): e for i, t in rows for e in [tool.encode(t or "", add_special_tokens=False).ids]}
    assert bpe.encode(docs(spark, [])).count() == 0


def test_bpe_driver_encodes_few_words_at_once(spark, monkeypatch):
    from tokenizers import Tokenizer

    tool, sizes = Tokenizer.from_file(bpe.default_file()), []

    class Told:
        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return tool.encode_batch_fast(words, **options)

    monkeypatch.setattr(bpe, "_tool", lambda model: Told())
    text = " ".join("w%d" % k for k in range(10_000))
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, [(1, text), (2, text)])).collect()}
    assert got[1] == got[2] == tool.encode(text, add_special_tokens=False).ids
    assert sum(sizes) >= 9999 and max(sizes) <= 5000


def test_workers_give_freed_memory_back(tmp_path):
    """Of many small pieces, every hundredth stays, so that the C library keeps the pages of the others."""
    import subprocess
    import sys

    code = f"""
import re, sys
sys.path[:0] = {sys.path!r}
import pyarrow as pa
from changelens.llm import bpe
def held():
    return int(re.search(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
model = open(bpe.default_file(), encoding="utf-8").read()
batch = pa.RecordBatch.from_pydict({{"block": pa.array([0], pa.int32()), "place": pa.array([0], pa.int32()), "word": ["a"]}})
list(bpe._encoded(iter([batch]), model))
before = held()
kept = [bytes(4000) for k in range(50_000)][::100]
print(held() - before)
list(bpe._encoded(iter([batch]), model))
print(held() - before)
"""
    left, swept = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split())
    assert left > 150 and swept < 40


def test_bpe_holds_no_frequent_words_as_python_objects():
    import tracemalloc

    import pyarrow as pa
    import zstandard

    frequent = pa.array(["w%d" % k for k in range(200_000)], pa.large_string())
    block = pa.table({"z": pa.array([zstandard.compress(t) for t in (b"w7 x w199999", b"b  w7 a", b"")], pa.binary())})
    tracemalloc.start()
    try:
        known, own = bpe._distinct(block, re.compile("[^ ]+"), frequent)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert known == {"w7": 7, "w199999": 199_999} and own == ["a", "b", "x"]
    assert most < 4 << 20


def brute_components(rows, width=3):
    sets = {i: frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset() for i, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())]}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [1000, 3])
def test_similarity_join(spark, block, monkeypatch):
    """With blocks of 3, searches are cut into pairs of blocks, and some clusters are searched bucket by bucket."""
    import random

    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = random.Random(5)
    rows = [r for r in ODD if r[0] is not None and r[0] != 6]
    for g in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 40, 120, 400]))]
        for k in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
            rows.append((100 + g * 10 + k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.similar(docs(spark, rows))[0].collect()}
    assert got == brute_components(rows)
    assert shingle_join.similar(docs(spark, []))[0].count() == 0


def test_units_hold_every_open_pair(spark):
    """Overlapping buckets are one unit; of equal buckets one is left; closed buckets and buckets of two are none."""
    buckets = {1: [10, 11, 12, 13], 2: [10, 11, 12, 13], 3: [13, 14, 15], 4: [20, 21, 22], 5: [30, 31]}
    closed = {20: 20, 21: 20, 22: 20}
    rows = [(sig, own[0], k, k, closed.get(k, k), 5) for sig, own in buckets.items() for k in own]
    members = spark.createDataFrame(rows, "sig long, lead long, rep long, own long, component long, n long")
    units = {}
    for r in shingle_join._units(members).collect():
        units.setdefault(r.unit, []).append(r.own)
    assert sorted(sorted(x) for x in units.values()) == [[10, 11, 12, 13, 14, 15]]


def test_components_drop_links_inside_groups(spark, monkeypatch):
    """Links meet labels once where groups are dense; chains, nulls and links to itself are known."""
    from changelens.llm import graph

    sizes, saved = [], graph.saved

    def noted(df):
        out = saved(df)
        sizes.extend([out.count()] if out.columns == ["a", "b"] else [])
        return out

    monkeypatch.setattr(graph, "saved", noted)
    dense = [(i, j) for i in range(12) for j in range(12) if i != j]
    got = graph.components(spark.createDataFrame(dense, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(12)} and sizes == [66, 0]
    chain = [(100 + (k * 7) % 31, 100 + ((k + 1) * 7) % 31) for k in range(30)] + [(5, 5), (6, None), (None, 7), (8, 9)]
    got = graph.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {k: 100 for k in range(100, 131)} | {5: 5, 8: 8, 9: 8} and len(got) == 34


def test_signatures_meet_when_similar():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (12, 30, 95, 300):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            k = int(rng.integers(0, max(1, n // 9)))
            b = np.unique(np.concatenate((a[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and len(a) != both:
                assert set(shingle_join.signatures(a, 90)) & set(shingle_join.signatures(b, 90))


def test_revisits_with_each_validator(spark):
    """Three responses and three revisits a URL, with each kind of validator."""
    kinds = ["etag", "last-modified", None]
    rows = []
    for page in range(30):
        kind = kinds[page % 3]
        rows += [(page * 10 + k, f"http://a.com/{page}", 5000 * k, "response", {kind: f"v{k}"} if kind else {}, f"body {page} {k}") for k in range(3)]
        rows += [(page * 10 + 5 + k, f"https://www.a.com/{page}/?utm_source=x", 5000 * k + 4000, "revisit", {kind: "v1"} if kind else {}, None) for k in range(3)]
    frame = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, headers map<string,string>, body string").withColumn("at", F.timestamp_seconds("s"))
    got = {r.record_id: (r.response_id, r.status, r.body) for r in warc.resolve(frame).collect()}
    same = lambda page, k: "unvalidated" if page % 3 == 2 else "resolved" if k == 1 else "mismatch"
    assert got == {page * 10 + 5 + k: (page * 10 + k, same(page, k), f"body {page} {k}" if same(page, k) == "resolved" else None) for page in range(30) for k in range(3)}


def test_revisits(spark):
    rows = [(1, "http://www.A.com/x/?utm_source=q", 10, "response", {"etag": "1", "date": "d1"}, "one"), (2, "https://a.com/x", 20, "response", {"etag": "2", "server": "s"}, "two"), (3, "http://a.com/x#f", 9000, "revisit", {"etag": "2", "date": "d3", "server": "no"}, None), (4, "http://a.com/x", 15, "revisit", {"etag": "9"}, None), (5, "http://b.com/", 5, "revisit", None, None), (6, None, 5, "revisit", None, None), (7, "http://a.com/x", None, "revisit", None, None), (8, "http://a.com/x", 21, "revisit", {}, None)]
    frame = spark.createDataFrame(rows, "record_id long, url string, s long, kind string, headers map<string,string>, body string").withColumn("at", F.timestamp_seconds("s"))
    got = {r.record_id: r for r in warc.resolve(frame).collect()}
    assert (got[3].status, got[3].response_id, got[3].body, got[3].headers) == ("resolved", 2, "two", {"server": "s", "etag": "2", "date": "d3"})
    assert [got[i].status for i in (4, 5, 6, 7, 8)] == ["mismatch", "orphan", "orphan", "undated", "unvalidated"]
    assert warc.resolve(frame.where("false")).count() == 0


def test_lm(spark):
    rows = [(i, " ".join(["the cat sat", "on The mat", "rare%d" % i][: 1 + i % 3])) for i in range(40)] + [(40, None), (41, "")]
    got = {r.doc_id: r for r in lm.scores(docs(spark, rows), block_bytes=200).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in (t or "").lower().split())
    texts = sum(not h for h in held.values())
    n, v = sum(c.values()) + texts, len(c) + 1
    for i, t in rows:
        w = (t or "").lower().split()
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((texts + 1) / (n + v + 1))
        assert got[i].base_score == pytest.approx(want) and got[i].held_out == held[i] and got[i].n_tokens == len(w) + 1
        assert got[i].n_known == sum(c[x] > 0 for x in w) + 1 and got[i].train_tokens == n and got[i].score < 0
    assert lm.scores(docs(spark, [])).count() == 0


def suffix_tree(texts, depth=lm.DEPTH, smoothing=2.0, least=2, divergence=1.0):
    """A brute-force tree: the log10 probability of a text."""
    symbols = lambda t: b" ".join(t.lower().encode().split()) + bytes([lm.END])
    counts = Counter()
    pad = bytes([lm.START]) * depth
    for t in texts:
        whole = pad + symbols(t)
        counts.update((whole[i - k : i], whole[i]) for i in range(depth, len(whole)) for k in range(depth + 1))
    follow = {}
    for (context, symbol), n in counts.items():
        follow.setdefault(context, {})[symbol] = n

    @functools.cache
    def p(context, symbol):
        lower = (lambda s: p(context[1:], s)) if context else (lambda s: 1 / 256)
        own = follow.get(context, {})
        total, smooth = sum(own.values()), smoothing * max(1, len(own))
        r = lambda s: (own.get(s, 0) + smooth * lower(s)) / (total + smooth)
        gain = sum(n * math.log(r(s) / lower(s)) for s, n in own.items())
        return r(symbol) if total >= least and gain > divergence * len(own) else lower(symbol)

    def score(t):
        whole = pad + symbols(t)
        return sum(math.log10(p(whole[i - depth : i], whole[i])) for i in range(depth, len(whole)))

    return score


def test_lm_scores_against_a_brute_force_tree(spark):
    import random

    rng = random.Random(8)
    rows = [(i, " \t".join(rng.choice(["the", "cat", "Sat", "on", "é", "mat", "tree"]) for _ in range(rng.randrange(14)))) for i in range(40)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    score = suffix_tree([t for i, t in rows if i not in held])
    rows.append((rows[3][0], rows[3][1]))  # a repeated row counts again
    score = suffix_tree([t for i, t in rows if i not in held])
    got = lm.scores(docs(spark, rows), block_bytes=300).collect()
    assert len(got) == len(rows) and len({r.held_out for r in got}) == 2
    for r in got:
        assert r.score == pytest.approx(score(dict(rows)[r.doc_id]))


def test_lm_of_odd_rows(spark):
    got = lm.scores(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1} and {r.n_tokens for r in got if r.doc_id == 6} == {3002}


def test_lm_blocks_come_and_go_in_bounded_batches():
    """Whatever a block holds, neither what it asks for nor what it gets is one Arrow batch."""
    import random

    import numpy as np
    import pyarrow as pa
    import zstandard

    rng = random.Random(3)
    texts = [" ".join("%06x" % rng.randrange(1 << 24) for _ in range(400)) for _ in range(400)]
    tool = zstandard.ZstdCompressor()
    block = pa.table({"block": pa.array([5] * 400, pa.int32()), "doc_id": range(400), "held_out": [i % 7 == 2 for i in range(400)], "z": [tool.compress(t.encode()) for t in texts]})
    asked = list(lm._asked(iter(block.to_batches(max_chunksize=90))))
    assert len(asked) > 2 and max(map(len, asked)) <= lm.ROWS and all(b["block"].unique().to_pylist() == [5] for b in asked)
    asked = pa.Table.from_batches(asked)
    words, n = (asked.filter(asked["word"].is_valid())[k].to_pylist() for k in ("word", "n"))
    own = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in t.encode().split())
    assert sorted(words) == sorted({w for t in texts for w in t.encode().split()}) and all(own[w] == k for w, k in zip(words, n))
    keys = asked["gram"].drop_null()
    assert asked["n"].to_pylist()[: len(keys)] and sum(asked["n"].to_pylist()[: len(keys)]) == sum(len(t) + 1 for i, t in enumerate(texts) if i % 7 != 2)
    size, none = len(keys) + len(words), lambda k, kind: pa.nulls(k, kind)
    got = pa.table(
        {
            "block": pa.array([5] * (400 + size), pa.int32()),
            "doc_id": pa.chunked_array([block["doc_id"].combine_chunks(), none(size, pa.int64())]),
            "key": pa.chunked_array([block["held_out"].combine_chunks().cast(pa.int64()), keys.combine_chunks(), pa.array([1] * len(words), pa.int64())]),
            "value": pa.chunked_array([none(400, pa.float64()), pa.array([-1.0] * len(keys)), pa.array(n, pa.float64())]),
            "data": pa.chunked_array([block["z"].combine_chunks(), none(len(keys), pa.binary()), pa.array(words, pa.binary())]),
        }
    ).take(np.random.default_rng(1).permutation(400 + size))
    [out] = lm._scored(iter(got.combine_chunks().to_batches(max_chunksize=1000)))
    rows = out.to_pylist()
    by_id = {r["doc_id"]: r for r in rows[:-1]}
    assert len(rows) == 401 and all(by_id[i]["score"] == -len(t) - 1 and by_id[i]["n_words"] == 400 and by_id[i]["held_out"] == (i % 7 == 2) for i, t in enumerate(texts))
    assert all(by_id[i]["n_known"] == sum(own[w] > 0 for w in t.encode().split()) for i, t in enumerate(texts))
    assert rows[-1]["n_words"] == sum(own.values()) and rows[-1]["n_known"] == len(own) and rows[-1]["logs"] == sum(i % 7 != 2 for i in range(400))


def test_lm_places():
    import numpy as np

    keys = np.random.default_rng(2).permutation(np.unique(np.random.default_rng(1).integers(0, 1 << 48, 50_000)))
    wanted = np.random.default_rng(3).integers(0, len(keys), 200_000)
    at = lm.Places(keys)
    assert (at(keys[wanted]) == wanted).all() and len(at(keys[:0])) == 0 and lm.Places(keys[:1])(keys[:1]).tolist() == [0]
    for k in (5, 1 << 50):
        with pytest.raises(KeyError):
            lm.Places(keys[keys != k])(np.array([k]))


def test_words_of_the_tokenizer_are_cut_where_its_pieces_end():
    from tokenizers import Tokenizer

    texts = ["Ab, c.d e.g. 3.14, _., x_, \u00e9, \u4e00. a  \n b ...x, it's. <|endoftext|>, q", "a..b ,c .", "\u0661. x\u0301. \u1e9e."]
    tool = Tokenizer.from_file(bpe.default_file())
    cut = bpe.words_of(open(bpe.default_file(), encoding="utf-8").read())
    assert cut is bpe.CUT
    for t in texts:
        words = cut.findall(t)
        assert "".join(words) == t and sum((tool.encode(w, add_special_tokens=False).ids for w in words), []) == tool.encode(t, add_special_tokens=False).ids


def test_rows_below_a_score_keep_their_columns(spark):
    rows = [(i, ("nasty fool " if i % 2 else "kind friend ") * 5) for i in range(60)] + [(900, None), (901, ""), (None, "kind friend"), (1, "nasty fool " * 5)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    frame = docs(spark, rows).selectExpr("doc_id", "text", "keep_id as sums", "n as n_words", "h as c0")
    got = toxicity.below(frame, labels, 0.5)
    assert got.columns == frame.columns and {r.doc_id for r in got.collect()} >= {i for i in range(60) if i % 2 == 0} | {None}
    assert not {r.doc_id for r in got.collect()} & {i for i in range(60) if i % 2}
    assert toxicity.below(frame.where("false"), labels, 0.5).count() == 0


def test_spanning_links_connect_what_is_similar():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        base = [rng.integers(0, 2**63, int(rng.integers(3, 200))).astype(np.uint64) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 90))):
            b = base[rng.integers(4)]
            k = int(rng.integers(0, len(b) // 8 + 1))
            sets.append(np.unique(np.concatenate((b[k:], rng.integers(0, 2**63, k).astype(np.uint64)))))
        n = len(sets)

        def labels(pairs, n=n):
            up = list(range(n))
            for _ in range(n):
                for a, b in pairs:
                    up[a] = up[b] = min(up[a], up[b])
            return up

        both = lambda i, j, sets=sets: len(np.intersect1d(sets[i], sets[j]))
        true = [(i, j) for i in range(n) for j in range(i) if 100 * both(i, j) >= 90 * (len(sets[i]) + len(sets[j]) - both(i, j))]
        links = shingle_join.spanning_links(sets, list(range(n)), np.arange(n), np.arange(n), 90)
        assert len(links) < n and labels(links) == labels(true)


def test_similarity_join_of_rows_with_one_id(spark):
    """Rows repeated with the same id, and rows of one id with different texts, are judged each by its own text."""
    base = [f"w{k}" for k in range(120)]
    near = [*base[:60], "x", *base[61:]]
    rows = [(1, " ".join(base)), (1, "another text of the same id"), (2, " ".join(near)), (2, " ".join(near)), (9, "y" * 40_000 + " " + "z " * 9000), (None, "alone here now"), (5, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in shingle_join.similar(docs(spark, rows))[0].collect())
    assert got == [(0, 1, 0), (1, 4, 1), (1, 118, 1), (2, 118, 1), (2, 118, 1), (5, 0, 5), (9, 2, 9)]


def test_classifiers_learn(spark):
    rows = [(i, ("nasty fool " if i % 2 else "kind friend ") * (3 + i % 4) + f"word{i % 9}") for i in range(400)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    for operator in (toxicity, quality):
        got = operator.scores(docs(spark, rows), labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        right = [(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        assert sum(right) / len(right) > 0.95
        assert operator.scores(docs(spark, rows), labels.where("false")).count() == len(rows)


def test_decontamination(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(30)] + [(90, "two words"), (91, None)]
    noise = lambda n: " ".join(word() for _ in range(n))
    changed = items[3][1].split()
    changed[4], changed[15] = "other", "thing"
    rows = [(1, noise(200) + " " + items[5][1] + " " + noise(90)), (2, noise(50) + " " + " ".join(changed)), (3, noise(300)), (4, None), (5, ""), (6, "so Two words, yes"), (7, " ".join(items[8][1].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    assert got == {(1, 5), (2, 3), (6, 90)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()} == {3, 4, 5, 7}
    assert decontaminate.matches(docs(spark, rows), bench.where("false")).count() == 0


def test_decontamination_of_cut_passages(spark):
    import random

    rng = random.Random(3)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [(k, noise(40), "an answer of its own") for k in range(20)]
    part = lambda k, a, b: noise(100) + " " + " ".join(items[k][1].split()[a:b]) + " " + noise(100)
    rows = [(1, part(1, 0, 30)), (2, part(2, 10, 40)), (3, part(3, 0, 26)), (4, noise(50) + " " + " ".join(items[4][1].split()[:30]) + " an answer of its own " + noise(50))]
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    found = lambda **options: {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, rows), bench, **options).collect()}
    assert found() == {(1, 1), (2, 2), (4, 4)}
    assert found(answer="answer") == {(4, 4)}


def test_longest_common_subsequence():
    assert decontaminate.common_length([b"a", b"b", b"a", b"c"], [b"x", b"a", b"a", b"c", b"b"]) == 3

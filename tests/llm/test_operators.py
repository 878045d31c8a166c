"""The training-data operators against brute force, round trips and odd inputs."""

import gzip
import hashlib
import io
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontam, langid, licenses, lm_chain, lm_mix, ngram_join, packing, quality, topk, toxicity, warc
from newsloom.llm.common import alnum_words, crc_mod_py, entered, space_words
from newsloom.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, y string, label int, raw binary"
LABELS = "doc_id bigint, quality int, toxic int"


def frame(spark, texts, langs=None):
    """Documents with extra columns whose names operators use inside; ids are positions."""
    rows = [(i, t, langs[i] if langs else None, "s", 1, "x", 3, b"z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t", "one", "one two three four", "ä ö ß", "word " * 30_000, "\x00\x1f !?", "same text of some words", "same text of some words"]


# --- WARC --------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, k int")


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"{i}" * 400 if i % 3 == 1 else "small", "d", 0) for i in range(60)]
    rows += [(100, None, None, "d", 0), (None, "u", big, "d", 0), (59, "http://h/59", "small", "d", 0)]
    got = [tuple(r)[:5] for r in warc.read(warc.write(pages(spark, rows), str(tmp_path / "w"), rows_per_shard=7, roll_bytes=900), str(tmp_path / "w")).collect()]
    best = {}
    for i, _, h, *_ in rows:
        if h and len(h) >= 1000 and i is not None:
            best[h] = max(best.get(h, -1), i)
    many = Counter(h for _, _, h, *_ in rows)
    want = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        to = best[h] if len(p) >= 1000 and many[h] > 1 and best[h] != i else None
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    names = sorted(n for n in os.listdir(tmp_path / "w") if n.endswith(".warc.gz"))
    assert len(names) > 9 and not [n for n in os.listdir(tmp_path / "w" / "_temporary") if not n.startswith(".")]
    with gzip.open(tmp_path / "w" / names[0]) as f:
        assert all(h["content-length"] for h, _ in warc.records(io.BytesIO(f.read())))


def test_warc_shards_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i}" * 30, "d", 0) for i in range(200)]
    sums = []
    for n in (1, 5):
        folder = str(tmp_path / f"p{n}")
        warc.write(pages(spark, rows).repartition(n), folder, rows_per_shard=20)
        sums.append({x: hashlib.sha256(open(os.path.join(folder, x), "rb").read()).hexdigest() for x in os.listdir(folder) if x.endswith(".gz")})
    assert sums[0] == sums[1] and len(sums[0]) > 5


def test_warc_is_read_by_many_tasks(spark, tmp_path):
    rows = [(i, None, f"{i} " * 400, "d", 0) for i in range(80)]
    manifest = warc.write(pages(spark, rows), str(tmp_path / "w"), rows_per_shard=5)
    files = manifest.count()
    found = warc.read(manifest, str(tmp_path / "w"))
    used = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert files >= 8 and spark.conf.get("spark.sql.adaptive.enabled") == "true" and used > files // 3


def test_warc_long_payloads_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "é" * 3_000_000, 7, "n", 9), (2, "u", "é" * 3_000_000, 7, "n", 9), (3, "u", "", 7, "n", 9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, size int, note string, shard int")
    got = sorted(tuple(r)[:5] for r in warc.read(warc.write(df, str(tmp_path / "w")), str(tmp_path / "w")).collect())
    long, none = hashlib.sha1(("é" * 3_000_000).encode()).hexdigest(), hashlib.sha1(b"").hexdigest()
    assert got == [(1, 6_000_000, long, "revisit", 2), (2, 6_000_000, long, "response", None), (3, 0, none, "response", None)]


def test_warc_empty(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


# --- licenses ----------------------------------------------------------------------------------


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_labels(text):
    """Every rule on the normal form; containment decided pair by pair."""
    normal = " " + " ".join(words_of(text)) + " "
    found = [(m.start(), m.end(), tier, i, label) for i, label, tier, _, rx in licenses.rules() for m in re.finditer(rf"(?<= )(?:{rx})(?= )", normal)]
    kept = set()
    for a, b, t, i, label in found:
        over = [e for e in found if e[0] <= a and e[1] >= b and e[2] >= t and e[3] != i and ((e[0], e[1]) != (a, b) or (e[2], -e[3]) > (t, -i))]
        if not over:
            kept.add(label)
    return kept


def test_license_scan_against_brute_force(spark):
    rng = random.Random(1)
    bits = ["All Rights Reserved", "CC-BY", "cc by 4.0", "GNU General Public License, version 3", "licensed under the Apache License, Version 2.0", "MIT license", "SPDX-License-Identifier: MIT",
            "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Mozilla Public License 2.0", "lorem ipsum", "copyright 2024", "License", "apache"]
    texts = [" ".join(rng.choice(bits) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(rng.randrange(8))) for _ in range(80)] + ODD
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words_of(t)
        places = [(j, label) for j in range(len(w)) for phrase, label in licenses.BASE.items() if w[j : j + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), t
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base))
        assert set(filter(None, r.labels.split(","))) == base | brute_labels(t), t
        assert 0 <= r.score <= 1


def test_license_rules_are_many_and_gated():
    book = licenses.rules()
    assert len(book) >= 300
    for _, _, _, key, rx in book:
        re.compile(rx)
        assert key


def example(parsed, rng):
    """A random string that a parsed regex matches."""
    out = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "ANY":
            out.append("q")
        elif name == "SUBPATTERN":
            out.append(example(arg[3], rng))
        elif name == "BRANCH":
            out.append(example(rng.choice(arg[1]), rng))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out.append({"LITERAL": lambda: chr(value), "RANGE": lambda: chr(rng.randint(*value)), "CATEGORY": lambda: "7"}[str(kind)]())
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            out += [example(body, rng) for _ in range(rng.randint(low, min(int(high), low + 2)))]
        else:
            raise AssertionError(name)
    return "".join(out)


def test_license_gates_pass_all_that_their_rules_match():
    rng = random.Random(5)
    for _, label, _, key, rx in licenses.rules():
        for _ in range(40):
            text = f" {example(re._parser.parse(rx), rng)} "
            if re.search(rf"(?<= )(?:{rx})(?= )", text):  # not where a blank ends it
                assert licenses.gate_of(key) in text, (label, key, text)


def test_license_names_without_other_keywords(spark):
    texts = ["Creative Commons Attribution-ShareAlike 4.0", "licensed under the Creative Commons Attribution-NonCommercial-NoDerivs", "Do What The Fuck You Want To Public License",
             "Public Domain Dedication and License", "Beerware License", "GPL3", "GNU LGPL2.1 or later", "AGPL3"]
    for r in licenses.scan(frame(spark, texts)).collect():
        assert set(r.labels.split(",")) == brute_labels(texts[r.doc_id]), texts[r.doc_id]


def test_license_plan_is_native(spark):
    plan = licenses.scan(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- top-k -------------------------------------------------------------------------------------


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3], 1) for i in range(400)]
    rows += [(400 + i, rows[20][1], 1) for i in range(60)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (None, [0.5] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df, block=64, query_block=5).collect())
    x = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and i < 900}
    want = []
    for q in (i for i in x if i % 20 == 0):
        best = sorted(((-int(x[q] @ x[c]), c) for c in x if c != q))[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)


def best_of(x, ids, j, k=20):
    return sorted((-sum(int(a) * int(b) for a, b in zip(x[j], x[i], strict=True)), int(ids[i])) for i in range(len(x)) if ids[i] != ids[j])[:k]


@pytest.mark.parametrize("kind", ["wide", "huge", "negative", "equal", "sparse", "zero"])
def test_topk_block_against_brute_force(kind):
    rng = np.random.default_rng(7)
    x = rng.integers(-12_000, 12_000, size=(600, 64))
    x[:300] = x[0] + rng.integers(-40, 40, size=(300, 64))
    x = {"wide": x, "huge": x * 5_000, "negative": -abs(x), "equal": np.tile(x[:3], (200, 1)), "sparse": x * (rng.random(x.shape) < 0.05), "zero": x * 0}[kind]
    ids = rng.permutation(5000)[:600]
    block = topk.Block(ids, x)
    for j, (scores, found) in enumerate(block.top(x[:8], ids[:8], 20)):
        assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == best_of(x, ids, j)


def test_topk_refuses_scores_over_64_bits():
    x = np.full((3, 4), 1 << 33)
    with pytest.raises(ValueError, match="64 bits"):
        list(topk.Block(np.arange(3), x).top(x[:1], np.zeros(1, int), 2))


def test_topk_of_large_unequal_and_repeated_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=3 + i % 3) * (1e6 if i % 2 else 1000)]) for i in range(150)]
    rows += [(200, []), (201, [-5.0]), (20, [1.0, 2.0]), (40, [7.0]), (40, [7.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, block=50, query_block=4).collect())
    x = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in x if i % 20 == 0}):
        own = min(v for i, v in x if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in x if i != q)[:20]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_topk_stops_before_half_of_the_postings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id is not null and embedding is not null").select("vec_id", "embedding").limit(4000).collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], dtype=np.float64)).astype(np.int64)
    ids = np.array([r["vec_id"] for r in rows])
    block, asked = topk.Block(ids, x), np.flatnonzero(ids % 20 == 0)
    for j, (scores, found) in zip(asked.tolist(), block.top(x[asked], ids[asked], 20), strict=True):
        if j < 400:
            assert list(zip((-scores).tolist(), found.tolist(), strict=True)) == best_of(x, ids, j)
    assert block.read < 0.5 * len(asked) * x.size
    assert block.scored < 0.6 * len(asked) * len(x)


def test_topk_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    few = topk.top_k(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 2048)]


# --- n-gram join -------------------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = space_words(t.encode() if t else None)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


def near_texts(seed, groups=25, copies=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(3)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([4, 12, 60, 150, 300]))
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own) + (" " + rng.choice(shared) if rng.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"block_shingles": 200}), (3, {"sketch_bits": 16, "block_shingles": 60})])
def test_ngram_join_against_brute_force(spark, seed, options):
    texts = near_texts(seed) + ODD
    got = sorted(tuple(r) for r in ngram_join.report(frame(spark, texts), **options).collect())
    assert got == brute_components(texts)


def test_ngram_join_keeps_one_of_each_group(spark):
    texts = near_texts(4, groups=8) + [None, None, ""]
    kept = ngram_join.kept(frame(spark, texts))
    want = sorted({c for _, _, c in brute_components(texts)})
    assert sorted(r.doc_id for r in kept.collect()) == want and kept.columns == DOCS.replace(",", "").split()[::2]


def test_ngram_join_keeps_one_row_of_repeated_and_null_ids(spark):
    t, u, v, w = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuvw")
    rows = [(1, t), (1, t), (2, t), (None, t), (None, u), (3, v), (3, v + " more"), (3, u + " " + w), (None, ""), (None, ""), (7, None), (7, None), (7, " \n")]
    df = spark.createDataFrame([(i, x, None, "s", k, "x", 3, b"z") for k, (i, x) in enumerate(rows)], DOCS)
    kept = ngram_join.kept(df)
    assert kept.schema == df.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    third = {k for k in got if k[0] == 3 and k[1].startswith("v")}
    assert len(third) == 1 and got == Counter([(1, t), (None, u), *third, (3, u + " " + w), (None, ""), (None, ""), (7, None), (7, None), (7, " \n")])


def test_ngram_join_empty_and_null_ids(spark):
    assert ngram_join.report(frame(spark, [])).count() == 0
    df = frame(spark, ["a b c d e f", "a b c d e f", "q"]).withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.report(df).collect()) == [(0, 1), (1, 1), (2, 2)]


def test_linker_derives_answers():
    base = np.arange(1000, dtype=np.uint64)
    sets = [base] + [np.delete(base, [i, i + 1]) for i in range(0, 200, 4)]
    sets.sort(key=len)
    linker = ngram_join.Linker(sets, (4, 5))
    linker.run()
    assert len(set(linker.label.tolist())) == 1 and linker.computed < 3 * len(sets)


# --- decontamination ---------------------------------------------------------------------------


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 13, 14, 30, 50)] + ["", None, "V1"]
    texts = []
    for _ in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if rng.random() < 0.6:
            src = items[rng.randrange(5)].split()
            a = rng.randrange(len(src))
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[a : a + rng.randrange(1, 40)]
        texts.append(", ".join(w).upper() if rng.random() < 0.5 else "\n".join(w))
    texts += ODD
    bench = spark.createDataFrame([*enumerate(items), (None, "v1 v2"), (1, items[1])], "item_id bigint, text string")
    for bound in (1 << 20, 80):
        got = {r.doc_id: r for r in decontam.report(frame(spark, texts), bench, max_broadcast_bytes=bound).collect()}
        for i, t in enumerate(texts):
            w = words_of(t)
            hit, found = set(), set()
            for item, s in enumerate(items):
                x = words_of(s)
                k = min(13, len(x))
                for a in range(len(x) - k + 1 if k else 0):
                    for j in range(len(w) - k + 1):
                        if w[j : j + k] == x[a : a + k]:
                            hit |= set(range(j, j + k))
                            found.add(str(item))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_modes(spark):
    item = " ".join(f"b{i}" for i in range(13))
    docs = frame(spark, ["clean words here", f"before {item}, after", None])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).orderBy("doc_id").collect()] == [0, 2]
    spans = decontam.decontaminate(docs, bench, mode="span").orderBy("doc_id").collect()
    assert spans[1].text == "before , after" and spans[0].text == "clean words here" and spans[2].text is None and spans[1].y == "x"
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.report(docs, none).where("contaminated").count() == 0


# --- packing -----------------------------------------------------------------------------------


def check_pieces(rows, ids, size=1024):
    pieces = sorted((r.doc_id, r.start) for r in rows)
    by_doc, by_sequence = {}, {}
    for r in rows:
        raw = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(raw) and r.ids_crc32 == zlib.crc32(np.array(raw, dtype="<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, spans in by_doc.items():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= size
    return len(pieces), len(by_sequence)


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "of", "Größe", "ciónado", "x1y2", "don't", "!!", "a\n\nb", "  ", "tab\there"], k=rng.randrange(0, 1500))) for _ in range(60)]
    texts += ["", None, "a <|endoftext|> b", " lead", "trail  ", "three   spaces", "é  x", "new\n \nline"]
    reference = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*(reference.encode(t or "", add_special_tokens=False).ids), 0] for i, t in enumerate(texts)}
    rows = packing.pack(frame(spark, texts), tokenizer_path()).collect()
    _, sequences = check_pieces(rows, ids)
    total = sum(map(len, ids.values()))
    assert sequences * 1024 <= total + 0.02 * total + 1024


def test_packing_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path(), max_chunks=20_000)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()] + ODD
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        for t, e in zip(part, reference.encode_batch([t or "" for t in part], add_special_tokens=False), strict=True):
            assert np.frombuffer(encoder.ids(t), "<u4").tolist() == e.ids


def test_packing_of_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c " * 300), (1, "a b c " * 300), (None, "x y"), (None, None)]
    df = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id bigint, text string, start int, sequence_id int, offset int")
    got = packing.pack(df, tokenizer_path()).collect()
    whole = sum(r["length"] for r in got)
    each = [sum(r["length"] for r in got if r["doc_id"] == i) for i in (1, None)]
    one = len(packing.Encoder(tokenizer_path()).ids("a b c " * 300)) // 4 + 1
    assert whole == sum(each) and each[0] == 2 * one and sum(r["doc_id"] is None for r in got) == 2


def test_cutting_stock_uses_the_demand_and_is_near_the_bound():
    rng = random.Random(3)
    demand = Counter(min(rng.randrange(1, 700), 512) for _ in range(20_000))
    plan = packing.solve(dict(demand), 1024)
    used = Counter()
    for pattern, n in plan:
        assert sum(k * a for k, a in pattern.items()) <= 1024
        for k, a in pattern.items():
            used[k] += a * n
    assert used == demand
    least = -(-sum(k * n for k, n in demand.items()) // 1024)
    assert sum(n for _, n in plan) <= least * 1.005 + 1


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_what_packing_keeps_in_a_worker_goes_when_another_operator_starts():
    packing.encoder_of(tokenizer_path())
    entered("packing", packing.encoder_of.cache_clear)
    entered("packing", packing.encoder_of.cache_clear)
    assert packing.encoder_of.cache_info().currsize == 1
    assert not list(ngram_join._sets(16, 5)(iter([]))) and packing.encoder_of.cache_info().currsize == 0


def test_ngram_sketch_counts_up_to_65535_in_two_bytes(monkeypatch):
    made, zeros = [], np.zeros
    monkeypatch.setattr(ngram_join.np, "zeros", lambda *a, **k: made.append(zeros(*a, **k)) or made[-1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(70_000)), pa.array([0] * 70_000), pa.array([b"a"] * 69_999 + [b"b"])], names=["doc_id", "digest", "raw"])
    rows = pa.Table.from_batches(ngram_join._sets(16, 5)(iter([batch, batch.slice(0, 0)]))).to_pylist()
    cells = np.frombuffer(zlib.decompress(next(r["cells"] for r in rows if r["kind"] == 1)), "<u2")
    assert sorted(cells[cells > 0].tolist()) == [1, 65535] and sum(r["kind"] == 0 for r in rows) == 70_000
    assert max(x.nbytes for x in made) == 2 << 16


# --- language model ----------------------------------------------------------------------------


def test_lm_base_score_against_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["the", "of", "cat", "Dog", "ZEBRA,", "é", *(f"r{i}" for i in range(30))], k=rng.randrange(0, 80))) for _ in range(60)] + ODD
    rows = {r.doc_id: r for r in lm_mix.score(frame(spark, texts), block_bytes=2000).collect()}
    tokens = [[*space_words(t.encode() if t else None), b"\n"] for t in texts]
    held = [crc_mod_py(i, 10) == 0 for i in range(len(texts))]
    c = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        assert r.score < 0
    assert rows[68].score == rows[69].score


def test_lm_prefers_seen_text(spark):
    texts = ["the cat sat on the mat and the dog ran to the cat"] * 40 + ["qx zzkw vvpq xxj wqqz the kkjx"] + ["the dog sat on the mat and the cat ran"]
    rows = {r.doc_id: r for r in lm_mix.score(frame(spark, texts)).collect()}
    assert rows[41].bits_per_byte < rows[40].bits_per_byte


def test_lm_counts_over_16_bits_keep_their_ratio():
    words = [b"\n ", b"baa ", b"bab ", b"caa ", b"cab "]
    counts = np.array([7, 5 * 10**7, 0, 10**7, 0])
    block = lm_mix.Block(words, counts)
    gram, n, _ = block.counted()
    mixer = lm_mix.Mixer()
    mixer.weights[:, :-1] = 1 / lm_mix.ORDERS
    mixer.RATE = 0
    lp = mixer.spelled(lm_mix.Walk(block, gram, lm_mix.gram_paths(gram, n))) / np.log(10)
    first = lp[0] - lp[1]  # "bab" and "cab" differ in their first byte
    assert first == pytest.approx(np.log10(5), abs=0.15)


def chain_by_hand(chain, texts, train, prices, counts, n_texts, size):
    """The chain one token at a time, with dictionaries of counts of all training texts."""
    one, two = counts
    squash = lambda x: 1 / (1 + np.exp(-min(12, max(-12, x))))
    out = []
    for words, mine in zip(texts, train, strict=True):
        own = [Counter(words), Counter(zip([None, *words], words, strict=False))]
        own = own if mine else [Counter()] * 2
        total = 0.0
        for i, w in enumerate(words):
            if i % size == 0:
                weights, maps = chain.weights.copy(), chain.map.copy()
                runs, hits, tries = [0] * 2, [0.5] * 2, [1.0] * 2
            b = words[i - 1] if i else None
            places = []
            back = next((j for j in range(i - 2, -1, -1) if words[j] == b), None) if i else None
            places.append(None if back is None else (float(words[back + 1] == w), i - 1 - back))
            n = one[b] - own[0][b] if i else n_texts - mine
            places.append((min(1.0, (two[b, w] - own[1][b, w]) / n), n) if n > 0 else None)
            state = []
            for k, place in enumerate(places):
                if place is None:
                    state.append((0.0, 0.0))
                    continue
                cell = min(lm_chain.CELLS - 1, int(np.log2(max(place[1], 1) + 0.5)))
                z = np.array([*(np.log(p / (1 - p)) for p in (chain.by_cell[k, cell], chain.by_run[k, runs[k]], hits[k] / tries[k])), 0.3])
                g = min(runs[k], 2)
                s = float(weights[k, g] @ z)
                m = min(16, max(0, int(np.rint(2 * s + 8))))
                state.append((min(1 - 1e-4, max(1e-4, (squash(s) + maps[k, m]) / 2)), place[0], z, g, squash(s), m))
            p = np.exp(np.longdouble(prices[w]))
            wholes = []
            for yes, said, *_ in reversed(state):
                p = yes * said + (1 - yes) * p
                wholes.append(p)
            total += float(np.log(p))
            reach = 1.0
            for k, (st, whole) in enumerate(zip(state, reversed(wholes), strict=True)):
                if len(st) < 3:
                    continue
                yes, said, z, g, mix, m = st
                share = float(yes * said / whole)
                weights[k, g] += lm_chain.RATE * reach * (share - mix) * z
                maps[k, m] += lm_chain.REFINE * reach * (share - maps[k, m])
                hits[k] += reach * share
                tries[k] += reach
                runs[k] = min(runs[k] + 1, 15) if share > 0.5 else 0 if reach > 0.5 else runs[k]
                reach *= 1 - share
        out.append(total)
    return out


def chain_texts(seed=3, n=40):
    rng = random.Random(seed)
    texts = [rng.choices(range(12), k=rng.randrange(0, 40)) + [12] for _ in range(n)]
    return texts + [list(texts[3]), list(texts[4]), [12], texts[5][:-1] * 3 + [12]]


def test_lm_chain_against_one_token_at_a_time(monkeypatch):
    monkeypatch.setattr(lm_chain, "STRETCH", 17)
    texts = chain_texts()
    rng = np.random.default_rng(1)
    train = rng.random(len(texts)) < 0.8
    learnt = [t for t, y in zip(texts, train, strict=True) if y]
    counts = [Counter(w for t in learnt for w in t), Counter(x for t in learnt for x in zip([None, *t], t, strict=False))]
    prices = np.log(rng.dirichlet(np.ones(13)))
    prices[5] = -900.0  # a very long token
    hashes = rng.integers(1, 1 << 63, size=13).astype(np.uint64)
    chain = lm_chain.Chain()
    chain.by_cell, chain.by_run = rng.uniform(0.1, 0.9, (2, lm_chain.CELLS)), rng.uniform(0.1, 0.9, (2, lm_chain.RUNS))
    chain.weights, chain.map = rng.normal(size=chain.weights.shape) / 2, rng.uniform(0.1, 0.9, chain.map.shape)
    ids, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    grams = lm_chain.Grams(ids, starts, hashes)
    slots, at = grams.slots(50)
    held = np.bincount(at, grams.counts(np.repeat(train, lengths)), len(slots)).astype(np.int64)
    places = lm_chain.Places(grams, starts, train, np.array([counts[0][w] for w in range(13)]), int(train.sum()), held[at])
    got = chain.run(places, starts, prices[ids])
    want = chain_by_hand(chain, texts, train, prices, counts, int(train.sum()), 17)
    assert np.allclose(np.add.reduceat(got, starts), want, rtol=1e-5)


def test_lm_gram_totals_over_blocks_and_shards():
    texts, rng = chain_texts(7, 60), np.random.default_rng(2)
    hashes = rng.integers(1, 1 << 63, size=13).astype(np.uint64)
    blocks = [texts[:20], texts[20:21], texts[21:]]
    made = []
    for block in blocks:
        lengths = np.array([len(t) for t in block])
        made.append(lm_chain.Grams(np.concatenate(block), np.cumsum(lengths) - lengths, hashes))
    for shards in (1, 7):
        asked = [list(lm_mix.gram_requests(g, np.ones(len(g.ids), dtype=bool), 20, shards)) for g in made]
        found = [[] for _ in blocks]
        for shard in range(shards):
            own = [(b, s, c) for b, rows in enumerate(asked) for at, s, c in rows if at == shard]
            if own:
                rest = lm_chain.totals([np.cumsum(lm_chain.unpack(s)) for _, s, _ in own], [lm_chain.unpack(c) for *_, c in own])
                for (b, *_), x in zip(own, rest, strict=True):
                    found[b].append(lm_chain.unpack(lm_chain.pack(x)))
        every = Counter()
        for g in made:
            for slot, n in zip((g.hashes >> np.uint64(44)).tolist(), g.counts(np.ones(len(g.ids), dtype=bool)).tolist(), strict=True):
                every[slot] += n
        for g, rest in zip(made, found, strict=True):
            slots, at = g.slots(20)
            mine = np.bincount(at, g.counts(np.ones(len(g.ids), dtype=bool)), len(slots))
            assert (np.concatenate(rest) + mine).tolist() == [every[s] for s in slots.tolist()]


def test_lm_query_against_one_process(spark):
    """The whole query over several blocks against the same steps in memory, token by token."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(120)]
    texts = [" ".join([*rng.choices(vocabulary, weights=range(1, 121), k=rng.randrange(0, 60)), f"own{i}", "edcba"[: i % 5] + f"{i}"]) for i in range(50)] + ODD[:6]
    texts += texts[:3]
    got = {r.doc_id: r for r in lm_mix.score(frame(spark, texts), block_bytes=1500, pack_bytes=1 << 20).collect()}
    tokens = [[*space_words(t.encode() if t else None), b"\n"] for t in texts]
    train = [crc_mod_py(i, 10) != 0 for i in range(len(texts))]
    learnt = [t for t, y in zip(tokens, train, strict=True) if y]
    counts = [Counter(w for t in learnt for w in t), Counter(x for t in learnt for x in zip([None, *t], t, strict=False))]
    names = sorted({w + b" " for t in tokens for w in t})
    block = lm_mix.Block(names, np.array([counts[0][w[:-1]] for w in names]))
    gram, n, _ = block.counted()
    total = sum(counts[0].values())
    escape = sum(x == 1 for x in counts[0].values()) / total
    spelled = lm_mix.Mixer().spelled(lm_mix.Walk(block, gram, lm_mix.gram_paths(gram, n)))
    prices = {w: np.log((1 - escape) * x / total) for w, x in counts[0].items()}
    unknown = [w[:-1] for w, x in zip(names, block.c.tolist(), strict=True) if not x]
    assert len(unknown) > 5
    prices |= dict(zip(unknown, np.log(escape) + spelled, strict=True))
    want = chain_by_hand(lm_chain.Chain(), tokens, train, prices, counts, sum(train), lm_chain.STRETCH)
    for i, x in enumerate(want):
        assert got[i].score * np.log(10) == pytest.approx(x, rel=1e-4), i


def test_lm_held_out_score_beats_the_unigram_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held, base = lm_mix.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held > 0.75 * base  # both are negative


def test_lm_counts_are_exact_however_the_vocabulary_is_cut(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 9))).encode() + b" " for _ in range(600)} | {b"q" * 3000 + b" ", b"\n "})
    c = np.array([rng.choice([0, 1, 5, 10**10]) for _ in words])
    cuts = [0, 1, 170, 171, 400, len(words)]
    blocks = [lm_mix.Block(words[a:b], c[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    grams, sums, _ = zip(*[b.counted() for b in blocks], strict=True)
    paths = np.split(lm_mix.gram_paths(np.concatenate(grams), np.concatenate(sums)), np.cumsum([len(g) for g in grams])[:-1])
    bits = ["".join(f"{x:08b}" for x in w) for w in words]
    at = 0
    for block, gram, path in zip(blocks, grams, paths, strict=True):
        walk = lm_mix.Walk(block, gram, path)
        for j in (0, 3, 8):
            prefix = walk.prefix(j)
            for i in np.flatnonzero(block.c == 0).tolist():
                for p in {0, 1, int(block.lengths[i]) - 1}:
                    head = bits[at + i][: 8 * p + j]
                    assert prefix[block.starts[i] + p] == sum(int(n) for n, b in zip(c, bits, strict=True) if b.startswith(head))
        gram, path = gram[np.argsort(gram)], path[np.argsort(gram)]
        for k in (1, 4):
            got = path[np.searchsorted(gram, block.grams(k))]
            for i in range(0, len(block.lengths), 40):
                w, p = words[at + i], int(block.lengths[i]) - 1
                want = sum(int(n) for n, v in zip(c, words, strict=True) for q in range(len(v)) if v[max(0, q - k) : q] == w[max(0, p - k) : p] and (q >= k or p >= k or q == p) and (q >= k) == (p >= k) and v[q] >> 3 == w[p] >> 3)
                assert got[block.starts[i] + p, 5] == want
        at += len(block.lengths)


def test_spelling_against_one_token_at_a_time_and_sums_below_one():
    words = sorted([bytes([b]) + b" " for b in range(256) if b not in b" abc"] + [b"a ", b"b ", b"c ", b"ab ", b"abc ", b"abd "])
    c = np.array([1000 if w in (b"a ", b"b ", b"c ", b"ab ", b"abc ") else 0 for w in words])
    block = lm_mix.Block(words, c)
    gram, n, wanted = block.counted()
    path = lm_mix.gram_paths(gram, n)
    walk = lm_mix.Walk(block, gram[wanted], path[wanted])
    got = lm_mix.Mixer().spelled(walk)
    unknown = [w for w, x in zip(words, c.tolist(), strict=True) if not x]
    weights, squares = lm_mix.Mixer().weights, lm_mix.Mixer().squares
    total = np.zeros(len(unknown))

    def bits(w):
        return "".join(f"{b:08b}" for b in w)

    def seen(test):
        return sum(int(x) for x, v in zip(c, words, strict=True) for q in range(len(v)) if x and test(v, q))

    for p in range(max(map(len, unknown))):
        for j in range(8):
            rows = []
            for i, w in enumerate(unknown):
                if p >= len(w):
                    continue
                def both(kind, k, w=w):
                    def test(v, q):
                        same = min(q, 15) == min(p, 15) if kind == lm_mix.PLACE else v[max(0, q - kind) : q] == w[max(0, p - kind) : p] and min(q, kind) == min(p, kind)
                        return same and bits(v[q : q + 1])[:k] == bits(w[p : p + 1])[:k]
                    return seen(test)
                pairs = [(both(k, j + 1), both(k, j)) for k in (1, 2, 3, 4)]
                pairs.append(tuple(sum(int(x) for x, v in zip(c, words, strict=True) if bits(v).startswith(bits(w)[: 8 * p + m])) for m in (j + 1, j)))
                pairs.append((both(lm_mix.PLACE, j + 1), both(lm_mix.PLACE, j)))
                x = [np.log((s + (e := 0.02 + 0.2 / (1 + n))) / (n - s + e)) for s, n in pairs]
                sign = 1 if bits(w)[8 * p + j] == "1" else -1
                gate = 2 * min(11, int(np.log2(pairs[4][1] + 1))) + (pairs[2][1] > 2)
                rows.append((i, np.array([*x, 0.3 * sign]), gate))
            steps = {}
            for i, x, gate in rows:
                q = 1 / (1 + np.exp(-np.clip(x @ weights[gate], -14, 14)))
                total[i] += np.log(np.clip(q, 1e-7, 1 - 1e-7))
                steps.setdefault(gate, []).append((1 - q) * x)
            for gate, found in steps.items():
                step = np.mean(found, axis=0)
                squares[gate] += step * step
                weights[gate] += lm_mix.Mixer.RATE * step / np.sqrt(squares[gate])
    assert np.allclose(got, total, rtol=1e-8)
    assert np.exp(got).sum() <= 1


def test_mixer_ends_in_a_map_that_moves_after_each_bit():
    mixer = lm_mix.Mixer()
    sign = np.where(np.arange(12_000) % 4 == 0, 1.0, -1.0)  # a quarter are ones, whatever the mix says
    s = np.full(12_000, 1.1) * sign
    p = 1 / (1 + np.exp(-s))
    assert np.array_equal(mixer.refined(s, p, 3, sign), p)  # nothing was seen before
    later = mixer.refined(s, p, 3, sign)
    one = 1 / (1 + np.exp(-1.1))
    assert np.allclose(later, np.where(sign > 0, (3 * one + 0.25) / 4, (3 * (1 - one) + 0.75) / 4), atol=1e-3)
    assert np.array_equal(mixer.refined(s, p, 4, sign), p) and mixer.seen.sum() == pytest.approx(36_000)


def test_lm_empty(spark):
    assert lm_mix.score(frame(spark, [])).count() == 0


# --- classifiers -------------------------------------------------------------------------------


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "moron", "worthless", "scum", "stupid"]
    automaton = toxicity.Automaton(terms, ["lowei"])
    rng = random.Random(0)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(k, rng.choice("abiot")), lambda: w and w.pop(k % len(w)), lambda: w and w.__setitem__(k % len(w), rng.choice("abiot"))])()
        word = "".join(w)
        want = min(((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.edits_for(t)), default=None)
        assert automaton.match(word) == ((want[1], want[0]) if want else None), word
    assert automaton.match("loweichaft") == ("lowei", 0) and automaton.match("lowe") is None


def test_quotation_is_not_abuse():
    s = toxicity.Scanner(toxicity.Automaton(list(toxicity.LEXICON)))
    abuse, quote, none = (s.features(t.encode()) for t in ("you are a stupid person", 'he said "you are a stupid person" and left', "you are a kind person"))
    assert abuse[0] == 1 and quote[0] == 0 and quote[4] > 0 and not none.any()


def test_marks_split_words_and_quote_by_kind():
    s = toxicity.Scanner(toxicity.Automaton(list(toxicity.LEXICON)))
    f = lambda text: s.features(text.encode())
    for text in ("you “idiot” there", "«moron»", "idiot’s word", "…idiot…", "id\u200biot", "—scum—", "x" * 70 + "—idiot"):
        assert f(text).any(), text
    for text in ("«you are a moron»", "“you are, as many others that we have met on the way, a complete idiot, you know”", "„du bist ein idiot“", '"a" b "moron"', "‹moron›"):
        assert not f(text)[0] and f(text)[4] > 0, text
    for text in ("“a” moron “b”", '"a" moron "b"', "“unclosed moron", "«a»\nmoron", "don’t be an idiot, it’s bad"):
        assert f(text)[0] == 1, text
    long = toxicity.Scanner(toxicity.Automaton({"w" * 80: 0}))
    assert long.features(b"w" * 80)[0] == 1


def synthetic(spark, n=400):
    rng = random.Random(8)
    good = [f"word{i}" for i in range(500)]
    texts, rows = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        w = [rng.choice(good) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(["idiot", "scum", "idi0t", "stupiid"])
            w[rng.randrange(60)] = "zorbl" + rng.choice(["an", "ix", "ot"])
        if junk:
            w = [x.upper() + "!!" for x in w[:20] * 3]
        texts.append(" ".join(w))
        rows.append((i, int(not junk), int(toxic)))
    return frame(spark, texts + ODD), spark.createDataFrame([*rows, (None, 1, 1), (1, None, None), (2, rows[2][1], rows[2][2])], LABELS), rows


def accuracy(scored, rows, column, held):
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    own = [r for r in rows if got[r[0]].held_out]
    assert own and all(got[i].held_out == held(i) for i, *_ in rows)
    return sum(got[r[0]].predicted == r[column] for r in own) / len(own)


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = synthetic(spark)
    assert accuracy(quality.score(docs, labels), rows, 1, lambda i: crc_mod_py(i, 5) == 0) > 0.95
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def test_quality_rules_compile_to_what_they_mean(spark):
    docs, labels, _ = synthetic(spark, 120)
    rules, bias = quality.model(docs, labels, 5, 0, (4000, 4000), "doc_id", "text")
    rows = quality.with_statistics(docs, ("doc_id",), "text").withColumn("s", quality.compiled(rules, bias)).collect()
    x = np.array([[r[c] for c in quality.STATISTICS] for r in rows])
    z = bias + sum(w * quality.holds(rule, x) for rule, w in rules)
    assert np.allclose([r.s for r in rows], 1 / (1 + np.exp(-np.clip(z, -30, 30)))) and rules


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = synthetic(spark)
    assert accuracy(toxicity.score(docs, labels), rows, 2, lambda i: crc_mod_py(i, 4) == 2) > 0.95
    kept = toxicity.rejected(docs, labels)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1


def test_toxicity_query_against_brute_force(spark):
    import unicodedata

    docs, labels, _ = synthetic(spark, 200)
    more = ["you “idiot” there", "«you are a moron»", "he said idiot", "idiot’s scumm stupiiid", "é—scum", None]
    extra = spark.createDataFrame([(1000 + i, t, None, "s", 1, "x", 3, b"z") for i, t in enumerate(more)], DOCS)
    docs = docs.union(extra)
    words, stems, stop, weights, bias = toxicity.fit(docs, labels, 4, 2, (5000, 3000), "doc_id", "text", 2000)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    known = {}

    def nearest(part):
        if part not in known:
            stem = [s for s in stems if part.startswith(s)]
            near = [(d, w) for w, k in words.items() if abs(len(w) - len(part)) <= k and (d := distance(part, w)) <= k]
            known[part] = (0, min(stem, key=lambda s: (len(s), s))) if stem else min(near, default=None)
            if known[part] and known[part][0] and part in stop:
                known[part] = None
        return known[part]

    def brute(text):
        text = text or ""
        quoted, opened = [False] * len(text), []
        pairs = {'"': '"', "“": "”", "«": "»"}
        for line in [m.span() for m in re.finditer(r"[^\n]+", text)]:
            at = line[0]
            while at < line[1]:
                end = text.find(pairs.get(text[at], "\0"), at + 1, line[1])
                if text[at] in pairs and end > 0:
                    quoted[at : end + 1] = [True] * (end + 1 - at)
                    at = end
                at += 1
        groups, part, start, group = [], "", 0, []
        for i, c in enumerate(text + " "):
            inside = c.isascii() and c.isalnum() or not c.isascii() and unicodedata.category(c)[0] not in "PSZ" and unicodedata.category(c) != "Cc"
            if inside:
                start = i if not part else start
                part += "" if unicodedata.category(c) == "Cf" else c.lower()
                continue
            if part:
                group.append((start, part))
                part = ""
            if c.isascii():
                groups += [group] if group or (i and not text[i - 1].isascii()) else []
                group = []
        hits, flat = [], []
        for group in groups:
            found = [(n[0], j, n[1], at) for j, (at, p) in enumerate(group) if (n := nearest(p))]
            if found:
                e, j, term, at = min(found)
                before = flat[-3:]
                hits.append((term, e, quoted[at] or any(p in toxicity.REPORTS for p in before)))
            flat += [p for _, p in group]
        if not hits:
            return np.zeros(7)
        exact, fuzzy = (sum(not q and (e > 0) == kind for _, e, q in hits) for kind in (False, True))
        n = len(groups)
        return np.array([exact > 0, np.log1p(exact), fuzzy > 0, np.log1p(fuzzy), np.log1p(sum(q for *_, q in hits)) / 2, min(1.0, 20 * (exact + fuzzy) / n), np.log1p(len({t for t, *_ in hits}))])

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    for i, t in texts.items():
        p = 1 / (1 + np.exp(-(brute(t) @ weights + bias)))
        assert got[i].score == pytest.approx(p, abs=1e-9) and got[i].predicted == int(p >= 0.3), t
    assert any(r.predicted for r in got.values()) and not all(r.predicted for r in got.values())


def test_classifiers_without_labels(spark):
    docs, none = frame(spark, ["fine words", "you idiot scum"]), spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert [r.predicted for r in toxicity.score(docs, none).orderBy("doc_id").collect()] == [0, 1]
    assert toxicity.score(frame(spark, []), none).count() == 0 and quality.score(frame(spark, []), none).count() == 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(3)
    stems = {"en": ["the", "thing", "with", "and", "shape"], "de": ["und", "schön", "nicht", "heit", "über"], "es": ["ción", "que", "niño", "los", "dad"]}
    langs = [rng.choice(sorted(stems)) for _ in range(240)]
    texts = [" ".join(rng.choice(stems[x]) + rng.choice(["", "er", "a"]) for _ in range(rng.randrange(3, 120))) for x in langs] + ODD
    langs += [None] * 6 + ["en", None, "en", None]
    rows = {r.doc_id: r for r in langid.predict(frame(spark, texts, langs)).collect()}
    held = [i for i in range(240) if rows[i].held_out]
    assert held and sum(rows[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert all(rows[i].held_out == (crc_mod_py(i, 3) == 1) and 0 <= rows[i].score <= 1 for i in rows)
    assert [rows[240 + i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4
    none = langid.predict(frame(spark, ["words", None]))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_language_query_against_brute_force(spark):
    import unicodedata

    rng = random.Random(5)
    stems = {"en": ["the", "thing", "with", "shape"], "de": ["und", "schön", "nicht", "über"], "th": ["กขค", "งจฉ", "ชซฌ"]}
    langs = [rng.choice(sorted(stems)) for _ in range(60)]
    texts = ["".join(rng.choice(stems[x]) + (" " if x != "th" else "") for _ in range(rng.randrange(3, 150))) for x in langs]
    texts += ["² ½ ① Ⅷ 12 _", None, "", "the und thing nicht " * 50, "THE²with½", *texts[:2]]
    langs += [None] * 5 + langs[:2]
    docs = frame(spark, texts, langs)
    rows = sorted((r["lang"], r["key"], r["text"]) for r in langid.sample(docs, 3, 1, 150, "doc_id", "text", "lang").collect())
    model = langid.train([(t, g) for g, _, t in rows])
    t_ = np.exp(model.transition)

    def brute(text):
        runs, run = [], ""
        for c in (text or "").lower() + " ":
            if unicodedata.category(c)[0] == "L":
                run += c
            elif run:
                runs += [run[a : a + 40] for a in range(0, len(run), 40)]
                run = ""
        total = np.zeros(len(model.langs))
        for a in range(0, len(runs), langid.BLOCK):
            e = [np.exp((s := sum(model.emission[f] for f in langid.features(w, model.lexicon))) - s.max()).astype(float) for w in runs[a : a + langid.BLOCK]]
            ahead = [e[0] / e[0].sum()]
            for x in e[1:]:
                ahead.append((ahead[-1] @ t_) * x)
                ahead[-1] /= ahead[-1].sum()
            back = np.ones(len(model.langs))
            for k in range(len(e) - 1, -1, -1):
                both = ahead[k] * back
                total += both / both.sum()
                back = t_ @ (e[k] * back)
                back /= back.sum()
        return (model.langs[int(total.argmax())], total.max() / len(runs)) if runs else ("und", 0.0)

    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        lang, score = brute(t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4), t
    assert got[60].lang_pred == "und" and got[62].lang_pred == "und"


def test_language_of_an_empty_table(spark):
    assert langid.predict(frame(spark, [])).count() == 0


def test_language_features_read_the_whole_word():
    assert langid.features("a" * 45 + "xyz", {}) != langid.features("a" * 45 + "zyx", {})


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    scores, transition = rng.normal(size=(1, 5, 3)), rng.normal(size=(3, 3))
    total, marginal = 0.0, np.zeros((5, 3))
    for path in product(range(3), repeat=5):
        p = np.exp(sum(scores[0, i, s] for i, s in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += p
        for i, s in enumerate(path):
            marginal[i, s] += p
    mask = np.ones((1, 5), dtype=bool)
    assert np.allclose(langid.marginals(scores, mask, transition)[0], marginal / total)
    assert np.allclose(langid.forward_backward(scores, mask, transition)[0][0], marginal / total)


def test_word_splitting():
    t = "Ab-c É9_x\x7f\x00y ﬁ"
    assert [w.decode() for w in alnum_words(t.encode())] == words_of(t)


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, tmp_path):
    """run() over a fixture with toxic, poor, near-equal, repeated and contaminated rows, stage by stage."""
    import corpus_pipeline

    rng = random.Random(12)
    good = [f"word{i}" for i in range(500)]
    texts, labels = [], []
    for i in range(240):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        w = [rng.choice(good) for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(["idiot", "scum", "idi0t"])
        if junk:
            w = [x.upper() + "!!" for x in w[:20] * 3]
        texts.append(" ".join(w))
        labels.append((i, int(not junk), int(toxic)))
    item = " ".join(rng.choice(good) for _ in range(20))
    clean = [i for i, q, t in labels if q and not t]
    texts += [texts[clean[0]], texts[clean[1]] + " tail", None, ""]
    texts += [" ".join([*rng.choices(good, k=20), item, *rng.choices(good, k=20)]) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[clean[3]], (None, texts[clean[4]], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    known = spark.read.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "ngram_jaccard", "decontamination", "packing"]

    # the first two by the scores of their operators, each on what the one before left
    def bag(df):
        return Counter((r.doc_id, r.text) for r in df.collect())

    first = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    bad = {r.doc_id for r in toxicity.score(docs, known).collect() if r.predicted}
    assert first.schema == docs.schema and bag(first) == Counter((i, t) for i, t, *_ in rows if i not in bad) and bad
    second = corpus_pipeline.keep_quality(spark, first, str(tmp_path))
    poor = {r.doc_id for r in quality.score(first, known).collect() if not r.predicted}
    left = [(i, t) for i, t, *_ in rows if i not in bad and i not in poor]
    assert bag(second) == Counter(left) and poor - {None}
    # then one row of each component of equal or near texts, by brute force
    groups = {}
    for (i, t), (_, n, top) in zip(left, brute_components([t for _, t in left]), strict=True):
        groups.setdefault(top if n else object(), []).append((i is None, i, t))
    stay = [min(g, key=lambda r: (r[0], r[1] or 0)) for g in groups.values()]
    third = corpus_pipeline.drop_near_copies(spark, second, str(tmp_path))
    assert Counter(r.doc_id for r in third.collect()) == Counter(i for _, i, _ in stay) and len(stay) < len(left)
    # then no contaminated text, by windows of 13 words
    window = item.split()
    hit = {i for _, i, t in stay if t and any(" ".join(window[a : a + 13]) in t for a in range(8))}
    want = {i for _, i, _ in stay if i not in hit}
    assert hit
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == want
    encoder = packing.Encoder(tokenizer_path())
    sizes = Counter()
    for r in got:
        sizes[r.doc_id] += r.length
    for _, i, t in stay:
        if i is not None and i in want:
            assert sizes[i] == len(encoder.ids(t)) // 4 + 1

"""The operators on whole texts against brute force."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from cases import PASSAGE, rows
from hitgauge.llm import decontamination, language, lattice, queries, rans, repetition, sentence_spans, simhash, token_files
from hitgauge.llm.components import components
from hitgauge.llm.texts import batch_like, kept, slices


SF = "/root/testdata/sf0.001"


# quality rules


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), max_size=4))
def test_suffix_repeats_by_hand(texts):
    symbols = np.array([s for t in texts for s in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = repetition.suffix_repeats(symbols, owner).tolist()
    wanted = []
    for t in texts:
        for i in range(len(t)):
            common = [next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 0) for j in range(len(t)) if j != i]
            wanted.append(max(common, default=0))
    assert found == wanted


def base(text):
    words = (text or "").encode().split()
    seen, marked = defaultdict(list), set()
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(x for i in at for x in range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(marked), failed,
    )


def test_rules_of_odd_rows(docs, none):
    out = repetition.judge(docs).select("_doc.*", F.struct("repetition.*").alias("r")).collect()
    assert len(out) == docs.count()
    for x in out:
        r = x.r
        assert base(x.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.base_failed and r.kept) and sum(s.end - s.start for s in r.spans) == r.covered_words
    kept = repetition.kept_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 6, 7, 8, 9, 10} | set()
    assert repetition.judge(none).count() == 0


def test_rules_of_the_table(sample):
    out = repetition.judge(sample).select("_doc.text", "repetition.*").collect()
    for r in out:
        assert base(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_limits_beyond_the_base_rules():
    def text(words, *repeats):  # different words in which passages of the given lengths occur twice
        parts = [f"u{i}" for i in range(words - 2 * sum(repeats))]
        for k, n in enumerate(repeats):
            passage = [f"r{k}x{i}" for i in range(n)]
            parts = passage + [f"m{k}"] + parts[:-1] + passage
        return " ".join(parts).encode()

    cases = [
        (text(1000, 99), False), (text(10_000, 900), False), (text(10_000, 51), False),  # longest repeat
        (text(10_000, 50), True), (text(1000, 40), True),
        (text(200, 12), False), (text(200, 10), True), (text(1000, 40, 12), False),  # covered share
        (text(200, 7, 7), True),  # repeats of under eight words count for the base rule only
    ]
    found = repetition.measure([t for t, _ in cases], *repetition.judge.__defaults__[1:])
    assert not any(found["base_failed"].to_pylist())
    assert found["kept"].to_pylist() == [k for _, k in cases]


def test_rules_take_a_batch_in_small_arrays():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50_000, 5000)) for _ in range(250)]  # 8 MB
    whole = pa.StructArray.from_arrays([pa.array(range(250)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    held = [b.column("repetition").field("longest_repeat") for b in repetition.judged(iter([batch_like({"_doc": whole})]), 1, 8, 0.1, 50)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = repetition.measure([t.encode() for t in texts], 8, 0.1, 50)["longest_repeat"]
    assert pa.concat_arrays(held).equals(wanted)
    assert peak < 64 << 20


def test_rules_get_a_text_once(docs):
    plan = repetition.judge(docs.withColumnRenamed("text", "Text"))._jdf.queryExecution().analyzed().toString()
    assert "_doc" in plan and "_text" not in plan


# language


def test_code_lengths_by_hand():
    texts = {"a": [b"abab", b"abc"], "b": [b"bbbb", b"xyz"]}
    order, names = 2, sorted(texts)
    counts = {n: Counter() for n in names}
    for n, own in texts.items():
        for t in own:
            padded = language.START * order + t
            counts[n].update(padded[i : i + order + 1] for i in range(len(t)))
    lang, code, n = [], [], []
    for i, name in enumerate(names):
        for gram, c in counts[name].items():
            lang.append(i), code.append(int.from_bytes(gram, "big")), n.append(c)
    trees = language.grow(names, order, np.array(lang), np.array(code, np.uint64), np.array(n, float))

    def bits(name, context, byte):
        k = len(context)
        after = Counter()
        for gram, c in counts[name].items():
            if gram[order - k : order] == context:
                after[gram[order:]] += c
        total, distinct = sum(after.values()), len(after)
        if after[byte]:
            return math.log2((total + distinct) / after[byte])
        escape = math.log2((total + distinct) / distinct) if total else 0
        return escape + (bits(name, context[1:], byte) if k else 8)

    for text in (b"abab", b"zz", b"", b"bbx"):
        padded = language.START * order + text
        wanted = [sum(bits(n, padded[i : i + order], padded[i + order : i + order + 1]) for i in range(len(text))) for n in names]
        assert np.allclose(trees.bits([text])[0], wanted, rtol=1e-5)


def test_language_of_odd_rows(spark, docs, none):
    trees = language.learn(docs)
    out = language.predict(docs, trees).select("_doc.doc_id", "_doc.text", "lang_pred", "score").collect()
    assert len(out) == docs.count()
    for r in out:
        known = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "de") and 0.5 <= r.score <= 1) if known else (r.lang_pred, r.score) == ("und", 0)
    assert {r.lang_pred for r in language.predict(docs, language.learn(none)).collect()} == {"und"}
    assert language.predict(none, trees).count() == 0


def test_languages_of_long_texts_are_learned(spark):
    said = {"aa": "abba baba ", "bb": "zyxw wxyz ", "cc": "äöü üöä "}
    rows = [(i, said[x] * (3000 if x != "bb" else 5), x) for i, x in enumerate(sorted(said) * 3)]
    trees = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), longest=1000)
    assert trees.languages == sorted(said)
    new = spark.createDataFrame([(i, said[x], x) for i, x in enumerate(said)], "doc_id bigint, text string, lang string")
    assert all(r.lang == r.lang_pred for r in language.predict(new, trees).select("_doc.lang", "lang_pred").collect())
    # a piece of at most 1,000 characters of each of three texts, counted by the bytes of one context-free code
    few = language.learn(spark.createDataFrame(rows[:1], "doc_id bigint, text string, lang string"), longest=10, order=0)
    assert len(few.bytes_[0][0]) <= 10


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op7_ppm_language(spark, sf).filter("held_out")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


# near-duplicates


def simple_fingerprint(text, words):
    parts = (text or "").encode().lower().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(nodes)), 2):
        if linked(nodes[i], nodes[j]):
            root[find(j)] = find(i)
    return [find(i) for i in range(len(nodes))]


@settings(deadline=None, max_examples=200)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.integers(1, 6))
def test_linked_fingerprints_meet(one, flipped, distance):
    """The pigeonring principle: any two within the distance share a chain key and pass its budgets."""
    flipped = sorted(flipped)[:distance]
    other = one ^ sum(1 << b for b in flipped)
    met = [i for i, m in enumerate(simhash.chain_keys(distance)) if one & m == other & m]
    assert any(len(simhash.within(np.array([one ^ other], np.uint64), i // 2, distance)) for i in met)


def test_near_duplicates_of_odd_rows(docs, none):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    texts = {xxhash.xxh64_intdigest((t or "").encode(), 42): t for _, t, *_ in rows()}
    ids = [r.doc_id for r in out]
    fps = [r.fp % 2**64 for r in out]
    assert sorted(fps) == sorted(simple_fingerprint(r[1], 4) for r in rows()) and texts
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    low = defaultdict(list)
    for i, r in enumerate(root):
        low[r].append(ids[i])
    for i, r in enumerate(out):
        assert r.component == min([x for x in low[root[i]] if x is not None], default=None)
    kept = simhash.one_per_group(docs, words=4)
    assert kept.columns == docs.columns and kept.count() == len(low)
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_per_group(none).count() == 0


def test_near_duplicates_of_the_table(spark):
    out = queries.op9_simhash_components(spark, SF).collect()
    fps = [int(r.fingerprint, 16) for r in out]
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    low = defaultdict(list)
    for i, r in enumerate(root):
        low[r].append(out[i].doc_id)
    assert all(r.component_id == min(low[root[i]]) for i, r in enumerate(out))


@pytest.mark.parametrize("matrix", [0, 2048])
@pytest.mark.parametrize("second", [None, 3])
@settings(deadline=None, max_examples=40, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**64 - 1), st.lists(st.sets(st.integers(0, 20), max_size=6), max_size=40), st.integers(4, 10))
def test_walk_connects_what_is_linked(monkeypatch, matrix, second, center, flips, distance):
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    fps = np.array(sorted({center ^ sum(1 << b for b in f) for f in flips}), np.uint64)
    wide = np.stack([fps, fps * np.uint64(3) % np.uint64(1024)], 1)

    def ok(i, j):
        chains = len(simhash.within(fps[i : i + 1] ^ fps[j : j + 1], 3, distance)) > 0
        return chains and (second is None or np.bitwise_count(wide[i, 1] ^ wide[j, 1]) <= second)

    links = simhash.walk(fps if second is None else wide, 3, distance, second)
    nodes = list(range(len(fps)))
    assert all(ok(i, j) for i, j in links)
    pairs = {frozenset(p) for p in links}
    direct, walked = groups(nodes, ok), groups(nodes, lambda i, j: frozenset((i, j)) in pairs)
    assert [direct.index(x) for x in direct] == [walked.index(x) for x in walked]
    assert len(links) == len(nodes) - len(set(direct))


def test_wide_near_duplicates_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500)
    out = simhash.near_duplicates(table, words=5, distance=10, second=16).collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    fps = [simhash.fingerprint(texts[r.doc_id].encode(), 5, True) for r in out]
    def near(a, b):
        differ = sorted((x ^ y).bit_count() for x, y in zip(a, b))
        return differ[0] <= 10 and differ[1] <= 16

    root = groups(fps, near)
    low = defaultdict(list)
    for i, r in enumerate(root):
        low[r].append(out[i].doc_id)
    assert all(r.component == min(low[root[i]]) for i, r in enumerate(out)) and len(low) < len(out)


def test_only_checked_pairs_are_linked(spark):
    draw = np.random.default_rng(5)
    template = [f"t{i}" for i in range(200)]

    def edited(text, n):  # n words in a row replaced: J = (S - n - 4) / (S + n + 4)
        at = int(draw.integers(5, len(text) - n - 5))
        return text[:at] + [f"e{draw.integers(1 << 40)}" for _ in range(n)] + text[at + n :]

    family = [edited(template, 40) for _ in range(60)]  # about 0.5 to 0.7 of each other
    copies = [edited(family[0], 2) for _ in range(8)]
    texts = [" ".join(t) for t in family + copies] + [" ".join(family[1]).upper(), None, "", "a", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    options = {"words": 5, "distance": 12, "second": 20}
    sets = [set(simhash.shingle_set(list(simhash.shingle_hashes((t or "").encode(), 5))).tolist()) for t in texts]
    prints = [simhash.fingerprint((t or "").encode(), 5, True) for t in texts]

    def proposed(a, b):
        differ = sorted((x ^ y).bit_count() for x, y in zip(prints[a], prints[b]))
        return differ[0] <= 12 and differ[1] <= 20

    def same(a, b):
        return sets[a] == sets[b] or proposed(a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    root = groups(list(range(len(texts))), same)
    low = {}
    for i, r in enumerate(root):
        low.setdefault(r, i)
    found = {r.doc_id: r.component for r in simhash.near_duplicates(docs, **options, share=0.8).collect()}
    assert found == {i: low[r] for i, r in enumerate(root)}
    assert {found[i] for i in range(60, 68)} == {0} and len(low) > simhash.one_per_group(docs, **options).count()
    assert simhash.one_per_group(docs, **options, share=0.8).count() == len(low)


@settings(deadline=None, max_examples=6)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "a bigint, b bigint"))
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    pairs = {frozenset(p) for p in links}
    root = groups(nodes, lambda a, b: frozenset((a, b)) in pairs)
    low = {r: min(n for n, x in zip(nodes, root) if x == r) for r in root}
    assert {r.node: r.root for r in found.collect()} == {n: low[r] for n, r in zip(nodes, root)}


# decontamination


def simple_score(text, item):
    a, b = (decontamination.words((x or "").encode()) for x in (text, item))
    row, best = [0] * (len(a) + 1), 0
    for w in b:
        new = [0]
        for j, v in enumerate(a, 1):
            new.append(max(0, row[j - 1] + (2 if v == w else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(b)) if b else 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=9)), min_size=1, max_size=5))
def test_alignment_by_hand(pairs):
    best, _ = decontamination.align([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    for (a, b), found in zip(pairs, best):
        said = simple_score(" ".join(f"w{x}" for x in a), " ".join(f"w{x}" for x in b))
        assert abs(said * 2 * len(b) - found) < 1e-9


def test_contaminated_odd_rows(spark, docs, none):
    edited = PASSAGE.replace("stone", "wooden").replace("great flood", "big wet flood").upper()
    items = [(1, PASSAGE), (1, PASSAGE), (2, edited), (3, None), (4, ""), (5, "two words"), (None, "w5x w6x w7x w8x w9x"), (7, "nothing like it at all here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    found = {(r.id, r.item_id): r.score for r in decontamination.contaminated(docs, bench).collect()}
    wanted = {}
    for doc, text, *_ in rows():
        for item, said in items:
            if len(decontamination.words((said or "").encode())) >= 3 and (s := simple_score(text, said)) >= 0.5:
                wanted[doc, item] = s
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    assert {(9, 1), (9, 2), (10, 1), (10, 2), (6, None)} <= found.keys()
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(r[0] or -1 for r in rows() if (r[0], 1) not in wanted and (r[0], None) not in wanted)
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.op4_benchmark_alignment(spark, SF).collect()}
    near = {(d.doc_id, i.item_id) for d in docs for i in items if set(i.text.lower().split()[:40]) & set(d.text.lower().split()) and len(d.text) < 4000 and simple_score(d.text, i.text) >= 0.5}
    assert near <= found


def test_common_seeds_of_short_items(spark):
    items = ["three rare words", "four quite rare words", "six words that all know well", PASSAGE, "a b a b a b a b"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [f"x{i} y{i} {said} z{i}" for i in range(40) for said in [*items, "six words that nobody knows"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontamination.contaminated(docs, bench, rare_share=0.0, rare_rows=0).collect()
    wanted = {(d, i) for d, t in enumerate(texts) for i, said in enumerate(items) if simple_score(t, said) >= 0.5}
    assert {(r.id, r.item_id) for r in found} == wanted and len(wanted) >= 240


def test_edited_copies_of_common_items(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    edited = "alpha beta gamma x1 epsilon zeta x2 theta iota x3".split()  # one seed left
    spread = "alpha beta x1 gamma delta epsilon x2 zeta eta theta iota x4 kappa".split()
    none_near = "alpha beta gamma and then nothing that belongs to it"
    others = [f"alpha beta gamma o{i} p{i} q{i} r{i} s{i} t{i} u{i}" for i in range(40)]  # share the seed
    bench = spark.createDataFrame(list(enumerate([item, *others])), "item_id bigint, text string")
    texts = [f"a{i} b{i} {item} c{i}" for i in range(300)]
    texts += [f"d{i} {' '.join(e)} e{i}" for i in range(5) for e in (edited, spread)] + [none_near]
    texts += ["z " * 60 + said + " y" * 60 for said in (" ".join(edited), none_near)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontamination.contaminated(docs, bench).collect()
    scores = {(d, i): simple_score(t, said) for d, t in enumerate(texts) if d < 2 or d >= 300 for i, said in enumerate([item, *others])}
    wanted = {k for k, s in scores.items() if s >= 0.5}
    assert {(r.id, r.item_id) for r in found if r.id < 2 or r.id >= 300} == wanted
    assert {(d, 0) for d in range(300)} <= {(r.id, r.item_id) for r in found}
    assert len({d for d, i in wanted if d >= 300}) >= 5


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30), st.lists(st.lists(st.integers(0, 6), min_size=3, max_size=9), min_size=1, max_size=4))
def test_screen_keeps_all_matches(text, items):
    block = decontamination.Items([" ".join(f"w{x}" for x in i).encode() for i in items], 3)
    numbers = np.array([block.numbers.get(f"w{x}", -1) for x in text], np.int64)
    best, _ = decontamination.align([numbers] * len(items), block.items)
    matches = {j for j, (b, i) in enumerate(zip(best, items)) if b >= len(i)}
    assert matches <= set(block.possible(numbers, list(range(len(items))), 0.5))


def test_blocks_of_items(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, f"{PASSAGE} {i}") for i in range(12)], "item_id bigint, text string")
    whole = {(r.id, r.item_id, r.score) for r in decontamination.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert {(r.id, r.item_id, r.score) for r in decontamination.contaminated(docs, bench).collect()} == whole


# sentence spans


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 9), max_size=20))
def test_runs_are_the_shortest(words):
    found = {tuple(r) for r in sentence_spans.runs(np.array(words, np.int64), 2, 12)}
    fits = [(a, b) for a in range(len(words)) for b in range(a + 2, len(words) + 1) if sum(words[a:b]) >= 12]
    wanted = {min((b, a) for a, b in fits if a == i)[::-1] for i in {a for a, _ in fits}}
    wanted |= {max((a, b) for a, b in fits if b == j) for j in {b for _, b in fits}}
    assert found == wanted


def simple_cut(docs, min_sentences=2, min_words=20):
    seen = defaultdict(set)
    order = lambda d, t, i: (d is not None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 1 << 63, i)
    for d, t in docs:
        parts = [s for _, _, s in sentence_spans.split((t or "").encode())]
        for a, b in sentence_spans.runs(np.array([len(p.split()) for p in parts], np.int64), min_sentences, min_words) if parts else []:
            seen[b"\n".join(parts[a:b])].add((order(d, t, int(a)), int(b)))
    gone = defaultdict(set)
    for where in seen.values():
        for (_, d, h, a), b in sorted(where)[1:]:
            gone[d, h].update(range(a, b))
    return {(d, t): len(gone[d or 0, order(d, t, 0)[2]]) for d, t in docs}


def test_spans_of_odd_rows(docs, none):
    out = sentence_spans.remove_repeats(docs).select("_doc.doc_id", "_doc.lang", "text", "n_sentences", "n_removed").collect()
    assert len(out) == docs.count()
    removed = {r.doc_id: r.n_removed for r in out if r.doc_id is not None}
    assert removed == {d: n for (d, _), n in simple_cut([(r[0], r[1]) for r in rows()]).items() if d is not None}
    assert removed[10] == 3 and removed[9] == 0
    texts = {r.doc_id: r.text for r in out}
    assert texts[10] == "Before it. After it came the sun." and texts[2] is None and texts[4] == " \t\n "
    assert sentence_spans.remove_repeats(none).count() == 0


def test_long_sentences(spark):
    draw = np.random.default_rng(3)
    said = lambda n: " ".join(f"w{x}" for x in draw.integers(0, 5000, n))
    one, line, periodic = said(52), said(2000), "all work " * 400
    texts = [
        one, one.upper(), f"Short before. {one}. Short after.", said(49), None, line, line,
        f"{said(30)} {line} {said(30)}", periodic.strip(), periodic.strip(),
    ]
    texts[4] = texts[3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.id: r for r in sentence_spans.remove_repeats(docs).select("_doc.doc_id", "*").withColumnRenamed("doc_id", "id").collect()}
    left = {i: len(r.text.split()) for i, r in out.items()}
    assert left[0] == 52 and left[1] == 0 and left[5] == 2000 and left[6] == 0 and left[9] == 0
    assert left[3] == left[4] == 49 and left[7] < 60 + 400 and 0 < left[8]
    docs = spark.createDataFrame([(1, f"One. {one}. Two."), (2, f"Other. {one}. Thing.")], "doc_id bigint, text string")
    kept = sentence_spans.remove_repeats(docs).select("_doc.doc_id", "text").collect()
    assert {r.doc_id: r.text for r in kept}[2] == "Other. Thing."
    for t in (line, periodic, one, "  " + line + " \n x " + periodic):
        parts = sentence_spans.split(t.encode())
        assert b" ".join(p for _, _, p in parts).split() == t.lower().encode().split()
        assert all(b == c for (_, b, _), (c, _, _) in zip(parts, parts[1:]))
        assert all(sum(1 for _ in p.split()) >= 25 for _, _, p in parts if len(parts) > 1 and p != b"x")


def test_spans_of_the_table(spark, sample):
    out = queries.op8_sentence_spans(spark, SF).collect()
    wanted = simple_cut([(r.doc_id, r.text) for r in sample.collect()])
    assert {r.doc_id: r.n_removed for r in out} == {d: n for (d, _), n in wanted.items()}


# lattice

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text("ab", min_size=1, max_size=7), max_size=5))
def test_lattice_sums_all_segmentations(words):
    scores = {b" ": -2.0, b"a": -1.5, b"b": -1.0, b" a": -0.9, b"ab": -1.2, b"bab": -3.0, b" ab": -2.2}

    def total(w):
        return 1.0 if not w else sum(math.exp(s) * total(w[len(p) :]) for p, s in scores.items() if w.startswith(p))

    model = lattice.Lattice(scores, -1.0)
    words = [w.encode() for w in words]
    wanted = [math.log10(total(b" " + w)) for w in words]
    assert np.allclose(model.words(words), wanted) if words else not len(model.words(words))
    assert np.allclose([model.long_word(b" " + w) / lattice.LN10 for w in words], wanted)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=6), st.integers(1, 5)), min_size=1, max_size=5))
def test_expected_pieces(counted):
    scores = {b" ": -2.0, b"a": -1.5, b"b": -1.0, b" a": -0.9, b"ab": -1.2, b"bab": -3.0, b" ab": -2.2}

    def ways(w):
        if not w:
            yield (), 1.0
        for p, s in scores.items():
            if w.startswith(p):
                for rest, x in ways(w[len(p) :]):
                    yield (p, *rest), math.exp(s) * x

    wanted = Counter()
    for w, n in counted:
        own = list(ways(b" " + w.encode()))
        for pieces, x in own:
            for p in pieces:
                wanted[p] += n * x / sum(y for _, y in own)
    model = lattice.Lattice(scores, -1.0)
    found = model.expected([w.encode() for w, _ in counted], np.array([n for _, n in counted]))
    for size, n in found.items():
        for piece, x in zip(model.pieces[size], n):
            assert abs(wanted[piece] - x) < 1e-6


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1 << 16])
def test_long_words_are_taken_in_stretches(monkeypatch, stretch):
    scores = {b" ": -2.0, b"a": -1.5, b"b": -1.0, b" a": -0.9, b"ab": -1.2, b"bab": -3.0, b" ab": -2.2, b"abab": -2.5}
    model = lattice.Lattice(scores, -1.0)
    monkeypatch.setattr(lattice, "STRETCH", stretch)
    for word in (b"a", b"ab", b"abbabab", b"ab" * 40 + b"bba" * 9):
        data = np.frombuffer(b" " + word, np.uint8).reshape(1, -1)
        wanted, found = ({size: np.zeros(len(keys)) for size, (keys, _) in model.tables.items()} for _ in "ab")
        model.equal_expected(data, np.array([3]), wanted)
        model.long_expected(b" " + word, 3, found)
        assert all(np.allclose(wanted[size], found[size]) for size in wanted)
        assert np.isclose(model.long_word(b" " + word), model.equal_words(data)[0])


def test_a_word_of_a_million_bytes(spark):
    rng = np.random.default_rng(5)
    block = bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 1_000_000)).decode()
    docs = spark.createDataFrame([(1, "some words " + block), (2, "more words")], "doc_id bigint, text string")
    short, long = sorted(lattice.score(docs, docs, PIECES).collect(), key=lambda r: -r.doc_id)
    assert (long.n_tokens, long.n_known, short.n_tokens) == (4, 4, 3)
    assert math.isfinite(long.score) and long.score < -1_000_000 * 0.5 < short.score


def test_passes_raise_the_likelihood(spark, sample):
    counts = lattice.word_counts(sample.select("text")).cache()
    likely = []
    for passes in (0, 1, 2, 3):
        model = lattice.train(counts, sample.count(), PIECES, passes)
        rows_ = counts.collect()
        likely.append(sum(r.n * p for r, p in zip(rows_, model.words([bytes(r.word) for r in rows_]))))
        assert sum(map(math.exp, model.scores.values())) + math.exp(model.end) <= 1 + 1e-9
    assert likely == sorted(likely) and likely[3] > likely[0]


def test_scores_of_odd_rows(docs, none):
    trained = docs.filter("doc_id % 2 = 0 or doc_id is null")
    out = lattice.score(docs, trained, PIECES, keep=["text"]).collect()
    assert len(out) == docs.count()
    words = lambda t: [*(t or "").encode().lower().split(), "end"]
    c = Counter(w for r in trained.collect() for w in words(r.text))
    n, v = sum(c.values()), len(c)
    for r in out:
        own = words(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert math.isfinite(r.score) and r.score < 0
    assert lattice.score(none, trained, PIECES).count() == 0
    bare = lattice.score(docs, none, PIECES).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in bare)


@pytest.mark.parametrize("head", [("HEAD_WORDS", 5), ("HEAD_BYTES", 12), ("HEAD_BYTES", 0)])
def test_rare_words_are_joined(docs, monkeypatch, head):
    trained = docs.filter("doc_id % 2 = 0")
    whole = sorted(map(tuple, lattice.score(docs, trained, PIECES).collect()), key=str)
    monkeypatch.setattr(lattice, *head)
    few = sorted(map(tuple, lattice.score(docs, trained, PIECES).collect()), key=str)
    assert [x[:4] for x in whole] == [x[:4] for x in few]
    assert np.allclose([x[4:] for x in whole], [x[4:] for x in few])


# token files


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 400), max_size=6000), st.integers(1, 3))
def test_blocks_round_trip(numbers, times):
    numbers = np.array(numbers * times, np.int64)
    table = rans.table_from_counts(np.bincount(numbers, minlength=500))
    assert table.freq.sum() == 1 << table.bits and all(table.freq[numbers] > 0)
    block = rans.encode(numbers, table)
    assert rans.decode(block, table).tolist() == numbers.tolist()


def test_stretches_and_damage():
    numbers = np.random.default_rng(1).zipf(1.3, 700_000) % 1000
    table = rans.table_from_counts(np.bincount(numbers, minlength=1000))
    block = rans.encode(numbers, table)
    step = rans.LANES * rans.CHECK_ROWS
    assert rans.decode_stretch(block, 1, table).tolist() == numbers[step : 2 * step].tolist()
    for at in (3, 40, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)


@pytest.mark.parametrize("by_word", [True, False])
def test_token_files_of_odd_rows(spark, docs, none, by_word, tmp_path):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(docs, str(tmp_path / "t"), file, 2, by_word=by_word)
    out = sorted(token_files.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(file)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r.id for r in out] == sorted([r[0] for r in rows()], key=lambda x: (x is not None, x))
    at, left = 0, Counter((r[0], tuple(ids(r[1]))) for r in rows())
    for r in out:
        left[r.id, tuple(r.ids)] -= 1
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert not any(left.values())
    token_files.write(none, str(tmp_path / "n"), file, 2)
    assert token_files.read(spark, str(tmp_path / "n")).count() == 0


def test_known_words_go_with_their_step():
    """What a worker remembers of words for token files is gone when quality rules run in it."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = token_files._tokenizer(f.read())
    texts = [b"some words to remember"]
    ids = token_files.encode_texts(model, texts, "<u2", True, None, kept("words"))
    batch = batch_like({"text": pa.array(["some words to remember"])})
    assert list(slices(iter([batch]), "text", step="words")) and len(kept("words")) == 4
    assert ids == token_files.encode_texts(model, texts, "<u2", True, None, kept("words"))
    row = pa.StructArray.from_arrays([batch.column("text")], names=["text"])
    assert list(repetition.judged(iter([batch_like({"_doc": row})]), 0, 8, 0.1, 50)) and not kept("words")


def test_tokens_of_the_table(spark, sample):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, wanted = 0, []
    for r in sample.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        wanted.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op3_rans_tokens(spark, SF).collect())) == wanted


# pipeline


def test_pipeline(spark, sample, docs, none):
    seen = sample
    for number, (_, work) in enumerate(corpus_pipeline.STAGES, 1):
        after = work(spark, seen, SF)
        if number < len(corpus_pipeline.STAGES):
            assert after.columns == sample.columns and after.schema.simpleString() == sample.schema.simpleString()
            ids = {r.doc_id for r in seen.collect()}
            assert {r.doc_id for r in after.collect()} <= ids
        else:
            assert after.count() == seen.count()
        seen = after
    for given_rows in (docs, none):
        now = given_rows
        for number, (_, work) in enumerate(corpus_pipeline.STAGES, 1):
            now = work(spark, now, SF)
            if number < len(corpus_pipeline.STAGES):
                assert now.columns == given_rows.columns
        now.count()
    assert corpus_pipeline.run(spark, SF).count() > 0

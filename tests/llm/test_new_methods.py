"""Seekable infill, license diagonals and the Merkle manifest against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from cases import SCHEMA, rows
from pyspark.sql import functions as F

from hitgauge.llm import frames, licenses, merkle, simhash
from hitgauge.llm.queries import LETTERS, op11_seekable_infill, op12_license_diagonals, op13_merkle_manifest
from hitgauge.staging import stage_path

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
LOW = str.maketrans(LETTERS, LETTERS.lower())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def same(found, wanted):
    def key(row):
        return tuple((v is None, str(v)) for v in row)

    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


# --- infill


def simple_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text)


def test_infill_query_against_brute_force(spark, tmp_path):
    extra = [(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(
        ["<P>", "a <M> b", "<P", "ü" * 40000 + "letters" * 30000 + "ß é 漢字🙂", "x" * 200000, "\x00\x00a", "é", "<S"] * 4
    )]
    docs = spark.createDataFrame(rows() + extra, SCHEMA)
    found = op11_seekable_infill(spark, table(spark, docs, tmp_path)).collect()
    same(found, [simple_infill(r.doc_id, r.text) for r in docs.collect()])
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_infill_of_a_sample(spark, sample, tmp_path):
    found = op11_seekable_infill(spark, "/root/testdata/sf0.001").collect()
    same(found, [simple_infill(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_frames_of_any_size(size):
    text = "Ab1 ünd  <xyz>🙂 rest of it, then 漢字 and letters".encode()
    units = UNIT.findall(text.decode())
    cut = [f for f in frames.cut_frames(text, max(size, 4))]
    assert b"".join(frames.stream(cut)) == text and sum(f[0] for f in cut) == len(units)
    for low in range(len(units) + 1):
        for high in range(low, len(units) + 1):
            p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
            for form, said in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
                out, prefix, middle = frames.arranged(cut, form, low, high)
                assert (b"".join(frames.stream(out)).decode(), prefix, middle) == (said, len(p), len(m))
                # restored from any other framing of the output, too
                again = frames.cut_frames(said.encode(), max(size, 4))
                for held in (out, again):
                    assert b"".join(frames.stream(held, frames.text_order(held, form))) == text


def test_only_cut_frames_are_opened(monkeypatch):
    text = b"one two three four five six seven eight nine ten " * 400
    cut, opened = frames.cut_frames(text, 500), []
    pack, unpack = frames._packer(1)
    monkeypatch.setattr(frames, "_packer", lambda level: (pack, lambda data: opened.append(data) or unpack(data)))
    frames.arranged(cut, "psm", 1000, 5000)
    assert len(opened) == 2 < len(cut)


def test_output_texts(spark, docs):
    path = stage_path(spark, "frames-test")
    frames.write_store(docs.withColumn("form", F.lit("clash")), path, frame_bytes=100)
    out = frames.output_texts(frames.infill(frames.read_store(spark, path), "doc_id")).collect()
    assert len(out) == len(rows())
    texts = sorted((r.text or "" for r in docs.collect()))
    assert sorted(r.restored for r in out) == texts and {r.doc.form for r in out} == {"clash"}
    assert all(("<M>" in r.output) == (r.form != "plain") for r in out)


# --- licenses


def simple_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def simple_scan(text, phrases=licenses.PHRASES, notices=licenses.NOTICES):
    words = simple_words(text)
    base, labels, score = [], set(), 0.0
    for t in phrases:
        said = simple_words(t.text)
        places = [i for i in range(len(words)) if words[i : i + len(said)] == said]
        base += [(p, t.label) for p in places]
        if places:
            labels.add(t.label)
            score = 1.0
    for t in notices:
        said = simple_words(t.text)
        k = min(4, len(said))
        lines = {}
        for i in range(len(words) - k + 1):
            for j in range(len(said) - k + 1):
                if words[i : i + k] == said[j : j + k]:
                    lines.setdefault(i - j, []).append((i, j))
        bands = []
        for d in sorted(lines):
            if not bands or d - bands[-1][-1] > 3:
                bands.append([])
            bands[-1].append(d)

        def share(ds):
            return len({j + x for d in ds for _, j in lines[d] for x in range(k)}) / len(said)

        for band in bands:
            at = [i for d in band for i, _ in lines[d]]
            whole = max(at) + k - min(at) <= 2 * len(said)
            reached = share(band) if whole else max(share([d]) for d in band)
            if reached >= 0.6:
                labels.add(t.label)
                score = max(score, reached)
    first, last = (min(base)[0], max(base)[0]) if base else (None, None)
    own = ",".join(sorted({b for _, b in base}))
    return len(words), len(base), first, last, own, ",".join(sorted(labels | {b for _, b in base})), score


NOTICE = next(t.text for t in licenses.NOTICES if t.label == "bsd")
CASES = [
    "MIT License", "mit-license, MIT  LICENSE mit", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
    "GNU General Public License GNU general public license x", "gnu general public licence", "cc  by cc by cc by",
    NOTICE, NOTICE.upper(), NOTICE.replace("binary forms", "in any binary or other forms"), NOTICE[40:],
    " ".join([NOTICE] * 3), "ümit license mit licenseü mitİ license K", "the terms of the gnu general " * 50,
    "filler words here " * 2000 + NOTICE + " filler" * 50, " ".join(NOTICE.split()[i % 20] for i in range(0, 90, 7)),
    "You may not use this file, except in compliance with the License. You may get a copy of the License at",
]


def test_scan_query_against_brute_force(spark, tmp_path):
    extra = [(200 + i, t, None, None, None, None, None, None) for i, t in enumerate(CASES * 2)]
    docs = spark.createDataFrame(rows() + extra, SCHEMA)
    found = op12_license_diagonals(spark, table(spark, docs, tmp_path)).collect()
    same(found, [(r.doc_id, *simple_scan(r.text)) for r in docs.collect()])
    assert sum("bsd" in r.labels for r in found) >= 10


def test_spans_and_shuffled_templates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"so {NOTICE} and the MIT License"), (2, None)], "doc_id int, text string")
    wanted = licenses.scan(docs).orderBy("doc_id").collect()
    assert [(s.first, s.last, s.label, s.share) for s in wanted[0].spans] == [(1, 21, "bsd", 1.0), (24, 25, "mit", 1.0)]
    assert wanted[1].spans == [] and wanted[1].score == 0
    monkeypatch.setattr(licenses, "BROADCAST_RUNS", 0)
    assert licenses.scan(docs).orderBy("doc_id").collect() == wanted
    assert licenses.scan(docs, phrases=[], notices=[]).select("labels").distinct().collect()[0].labels == ""


# --- manifest


def simple_leaf(r, text):
    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(map(framed, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def simple_tree(nodes):
    """(root, path of each node as (left, right))."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, i in zip(paths, where):
            run, own = runs[i // 8], i % 8
            path.append(("".join(run[:own]), "".join(run[own + 1 :])))
        nodes, where = [sha("".join(run)) for run in runs], [i // 8 for i in where]
    return nodes[0], paths


def simple_manifest(docs):
    groups = {}
    for r in docs:
        low = r.text and r.text.translate(LOW)
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        groups.setdefault(r.lang, []).append((r.doc_id, simple_leaf(r, r.text), simple_leaf(r, low if hit else r.text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    trees = {g: simple_tree([x[1] for x in own]) for g, own in groups.items()}
    root, upper = simple_tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, above in zip(order, upper):
        subroot, paths = trees[g]
        for (doc_id, leaf, other), path in zip(groups[g], paths):
            path = path + above
            node = other
            for left, right in path:
                node = sha(left + node + right)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 1], [600, 3, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_manifest_of_groups(spark, tmp_path, sizes):
    made = [
        (1000 * g + i, f"Text {i % 7}", None if g == 1 else f"l{g}é", "s", i, "x", None, 1) for g, n in enumerate(sizes) for i in range(n)
    ]
    docs = spark.createDataFrame(made, SCHEMA)
    same(op13_merkle_manifest(spark, table(spark, docs, tmp_path)).collect(), simple_manifest(docs.collect()))


def test_manifest_of_cases(spark, docs, tmp_path):
    found = op13_merkle_manifest(spark, table(spark, docs, tmp_path)).collect()
    same(found, simple_manifest(docs.collect()))
    assert {r.verified for r in found} == {True, False}


def test_manifest_of_equal_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "same", None, None, None, None, None, None)] * 70, SCHEMA).repartition(5)
    found = op13_merkle_manifest(spark, table(spark, docs, tmp_path)).collect()
    same(found, simple_manifest(docs.collect()))


def test_places_follow_partitions(spark):
    made = spark.range(0, 5000, 1, 13).select((F.col("id") % 3).cast("string").alias("g"), (-F.col("id")).alias("k"))
    held = merkle.numbered(made, "g", ["k"]).collect()
    assert {(r.g, r.pos) for r in held} == {(str(-k % 3), i) for g in range(3) for i, k in enumerate(
        sorted(-x for x in range(5000) if x % 3 == g))}
    assert all(r.pos == sum(1 for x in range(5000) if x % 3 == int(r.g) and -x < r.k) for r in held[::97])


def test_empty_tables(spark, none, tmp_path):
    path = table(spark, none, tmp_path)
    for query in (op11_seekable_infill, op12_license_diagonals, op13_merkle_manifest):
        assert query(spark, path).collect() == []


# --- near-duplicates by bands and centres


def test_bands_meet_at_the_share():
    draw = np.random.default_rng(3)
    met = {}
    for share in (0.5, 0.8, 0.9):
        n, hits = 300, 0
        both = round(2 * n * share / (1 + share))
        for _ in range(200):
            made = draw.integers(0, 2**63, 2 * n - both, np.uint64)
            one, other = simhash.band_keys(np.sort(made[:n])), simhash.band_keys(np.sort(made[n - both :]))
            hits += bool(set(one.tolist()) & set(other.tolist()))
        met[share] = hits / 200
    assert met[0.9] == 1 and met[0.8] > 0.96 and met[0.5] < 0.25


def test_pairs_within_the_distance_pass_the_ring():
    draw = np.random.default_rng(4)
    for distance in (3, 12, 20):
        bits = [int(draw.integers(0, 2 * distance)) for _ in range(300)]
        differ = np.array([sum(1 << int(b) for b in draw.choice(64, n, replace=False)) for n in bits], np.uint64)
        assert simhash.passes(differ, distance).tolist() == [n <= distance for n in bits]


@pytest.mark.parametrize("size, tile", [(10, 1024), (60, 16), (200, 32)])
def test_template_families_stay_narrow(spark, monkeypatch, size, tile):
    """Members of a family around one page and of a family without one, in tiles of any size."""
    draw = np.random.default_rng(size)
    monkeypatch.setattr(simhash, "TILE", tile)

    def edited(text, n):
        at = int(draw.integers(5, len(text) - n - 5))
        return text[:at] + [f"e{draw.integers(1 << 40)}" for _ in range(n)] + text[at + n :]

    page, other = ([f"{x}{i}" for i in range(200)] for x in "ab")
    texts = [page] + [edited(page, 12) for _ in range(size)] + [edited(other, 40) for _ in range(size)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = []
    real = simhash.linked_members

    def counted(*args):
        out = real(*args)
        assert len(out) < max(2, len(args[0]))  # a tile's links are fewer than its members
        return out

    monkeypatch.setattr(simhash, "linked_members", counted)
    pairs, centred = [], simhash.centred_pairs
    monkeypatch.setattr(simhash, "centred_pairs", lambda m, hot: (rows.append(m.count()), pairs.append(centred(m, hot)))[1] or pairs[-1])
    found = {r.doc_id: r.component for r in simhash.near_duplicates(docs, words=5, distance=20, second=20, share=0.8).collect()}
    sets = [set(simhash.shingle_set(list(simhash.shingle_hashes(t.encode(), 5))).tolist()) for t in texts]
    assert all(found[i] == 0 for i in range(size + 1) if len(sets[i] & sets[0]) >= 0.8 * len(sets[i] | sets[0]))
    assert len({found[i] for i in range(size + 1, len(texts))}) == size
    assert pairs[0].count() <= rows[0]


def test_copies_of_one_text_in_a_hot_node(spark):
    rows = [(i if i % 3 else None, "the same short text of some words" if i < 2500 else f"text {i} of its own kind") for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 2600 and sum(r.component == 1 for r in found) >= 2500


def test_the_rings_propose_pairs_by_themselves(spark, monkeypatch):
    """Without any band, all pairs within four bits of a half that share enough shingles are linked."""
    draw = np.random.default_rng(6)
    pages = [[f"{p}w{i}" for i in range(300)] for p in range(12)]
    texts = []
    for page in pages:
        for n in (0, 1, 2, 8):
            at = int(draw.integers(5, 280))
            texts.append(" ".join(page[:at] + [f"e{draw.integers(1 << 40)}" for _ in range(n)] + page[at + n :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    real = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: real(*a).withColumn("keys", F.array().cast("array<bigint>")))
    found = {r.doc_id: r.component for r in simhash.near_duplicates(docs, words=5, distance=20, second=20, share=0.8).collect()}
    sets = [set(simhash.shingle_set(list(simhash.shingle_hashes(t.encode(), 5))).tolist()) for t in texts]
    prints = [simhash.fingerprint(t.encode(), 5, True) for t in texts]
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            near, far = sorted((x ^ y).bit_count() for x, y in zip(prints[i], prints[j]))
            if near <= 4 and far <= 20 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                linked += 1
                assert found[i] == found[j]
    assert linked >= 12 and len(set(found.values())) >= 12

"""SQL of the named queries that SQL can express, for DuckDB over the same tables."""

from hitgauge.llm.licenses import NOTICES, PHRASES

_LCG = "((k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT)"

_JUMP = """
{name} AS (
    SELECT id, (-1)::BIGINT AS b, 0::BIGINT AS j, {first} AS k FROM ids
    UNION ALL
    SELECT id, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT, {next}
    FROM {name} WHERE j < {n}
)"""


def _jump(name: str, n: int) -> str:
    first = "((CASE WHEN id < 0 THEN id::HUGEINT + 18446744073709551616::HUGEINT ELSE id::HUGEINT END) * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT"
    return _JUMP.format(name=name, n=n, first=first, next=_LCG)


OP10 = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
{_jump("a", 24)}, {_jump("b25", 25)},
shards AS (SELECT id, max(b) AS shard FROM a GROUP BY id),
grown AS (SELECT id, max(b) AS grown_shard FROM b25 GROUP BY id),
crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]),
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
        FROM range(256) r(i))
),
d AS (
    SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
            lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32
    FROM documents, crc_table
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3),
        doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
    grown_shard::INT AS grown_shard
FROM d JOIN shards ON shards.id = coalesce(doc_id, 0) JOIN grown ON grown.id = coalesce(doc_id, 0)
"""

#: Everything but the last select; ``mixed`` has a row for each document, with all its columns.
MIX = """
sized AS (
    SELECT *, coalesce(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}
),
liked AS (SELECT *, (size * 1000) // (size + 500) AS pref FROM sized),
per0 AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(pref * size)::BIGINT AS liked,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
    FROM liked GROUP BY source
),
per1 AS (
    SELECT *, source_size * 3 AS most, row_number() OVER o AS place,
        (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER p, 0))::DOUBLE AS remaining,
        (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS weights
    FROM per0
    WINDOW o AS (ORDER BY (source_size * 3) / weight, source NULLS LAST),
        p AS (ORDER BY (source_size * 3) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
per2 AS (SELECT *, remaining / weights AS level FROM per1),
per3 AS (SELECT *, min(place) FILTER (level * weight <= most) OVER () AS first_free FROM per2),
per4 AS (SELECT *, max(level) FILTER (place = first_free) OVER () AS final FROM per3),
per5 AS (
    SELECT source, source_size, liked, CASE WHEN place < first_free THEN most::DOUBLE ELSE final * weight END AS target
    FROM per4
),
per6 AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        CASE WHEN source_size > 0 THEN liked::DOUBLE / source_size ELSE 0.0 END AS mean FROM per5
),
per AS (
    SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, target - floor(rate) * source_size AS rest FROM per6
),
drawn0 AS (
    SELECT l.*, p.source_size, p.target, p.whole, p.part, p.rest, p.mean,
        (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u,
        p.part + least(p.part, 1 - p.part) * 0.5::DOUBLE * (pref - p.mean) / 1000 AS chance
    FROM liked l JOIN per p ON l.source IS NOT DISTINCT FROM p.source
),
drawn AS (
    SELECT *, CASE WHEN part > 0 AND part < 1 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q FROM drawn0
),
summed AS (
    SELECT source, q, size, rest,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM drawn WHERE q IS NOT NULL
),
cut AS (SELECT source, max(q) AS last FROM summed WHERE before + size / 2 <= rest GROUP BY source),
mixed AS (
    SELECT d.*, (whole + CASE WHEN q <= last THEN 1 ELSE 0 END)::BIGINT AS copies
    FROM drawn d LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
)"""

OP6 = f"""
WITH {MIX.format(table="documents", text="text")}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM mixed
"""

_CRC_TABLE = """
crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, [1, 2, 3, 4, 5, 6, 7, 8]),
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
        FROM range(256) r(i))
)"""

#: crc32 of an integer's decimal digits (ASCII, so a character is a byte)
_CRC_DIGITS = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split({id}::VARCHAR, ''), lambda h: ord(h)::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)))"""


def _framed(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


_LEAF = "sha256({id} || {source} || {lang} || {n_chars} || {text})"


def _leaf(text: str) -> str:
    return _LEAF.format(
        id=_framed("doc_id"), source=_framed("source"), lang=_framed("lang"), n_chars=_framed("n_chars"), text=_framed(text)
    )


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, start: str) -> str:
    """Nodes (grp, k, i, d, n) of all levels, with what stands left and right of them below their parent."""
    return f"""
{name} AS (
    {start}
    UNION ALL
    SELECT grp, k + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (max(n) + 7) // 8
    FROM {name} WHERE n > 1 GROUP BY grp, k, i // 8
),
{name}_sides AS (
    SELECT grp, k, i, coalesce(string_agg(d, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name} WHERE n > 1 WINDOW b AS (PARTITION BY grp, k, i // 8 ORDER BY i)
)"""


OP13 = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
    SELECT doc_id, coalesce('+' || lang, '-') AS grp, lang, {_leaf("text")} AS leaf,
        CASE WHEN {_CRC_DIGITS.format(id="doc_id")} % 3 = 0 THEN {_leaf(_LOW)} ELSE {_leaf("text")} END AS other
    FROM documents, crc_table
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS i,
        count(*) OVER (PARTITION BY grp) AS n
    FROM leaves
),
{_tree("low", "SELECT grp, 0 AS k, i, leaf AS d, n FROM placed")},
subroots AS (
    SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp <> '-', encode(substr(grp, 2))) - 1 AS i, count(*) OVER () AS n
    FROM low WHERE n = 1
),
{_tree("high", "SELECT 0 AS grp, 0 AS k, i, subroot AS d, n FROM subroots")},
whole AS (SELECT d AS root FROM high WHERE n = 1),
climb AS (
    SELECT doc_id, leaf, other, grp, i AS place, i AS at, 0 AS k, false AS up, '' AS said, other AS node FROM placed
    UNION ALL
    SELECT c.doc_id, c.leaf, c.other, c.grp, c.place, coalesce(s.i, h.i, u.i) // (CASE WHEN s.i IS NULL AND h.i IS NULL THEN 1 ELSE 8 END),
        CASE WHEN s.i IS NULL AND h.i IS NULL THEN 0 ELSE c.k + 1 END, c.up OR s.i IS NULL,
        c.said || coalesce(s.l || s.r, h.l || h.r, ''),
        CASE WHEN s.i IS NOT NULL THEN sha256(s.l || c.node || s.r) WHEN h.i IS NOT NULL THEN sha256(h.l || c.node || h.r) ELSE c.node END
    FROM climb c
    LEFT JOIN low_sides s ON NOT c.up AND s.grp = c.grp AND s.k = c.k AND s.i = c.at
    LEFT JOIN high_sides h ON c.up AND h.k = c.k AND h.i = c.at
    LEFT JOIN subroots u ON NOT c.up AND u.grp = c.grp
    WHERE NOT c.up OR h.i IS NOT NULL
),
ended AS (SELECT c.* FROM climb c LEFT JOIN high_sides h ON h.k = c.k AND h.i = c.at WHERE c.up AND h.i IS NULL)
SELECT doc_id, leaf, subroot, root, sha256(said) AS proof_sha256, node AS folded_root, node = root AS verified
FROM ended JOIN subroots USING (grp), whole
"""

_TEMPLATES = ", ".join(
    f"({i}, '{t.label}', '{t.text}', {t.phrase})" for i, t in enumerate([*PHRASES, *NOTICES])
)


def _words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


_COVERED = "len(list_distinct(flatten(list_transform({places}, lambda p: range(p, p + least(length, 4))))))"

OP12 = f"""
WITH templates AS (
    SELECT template, label, phrase, {_words("said")} AS words FROM (VALUES {_TEMPLATES}) v(template, label, said, phrase)
),
runs0 AS (
    SELECT *, len(words) AS length, least(len(words), 4) AS k, unnest(range(len(words) - least(len(words), 4) + 1)) AS place
    FROM templates
),
runs AS (SELECT * EXCLUDE words, array_to_string(words[place + 1 : place + k], ' ') AS said FROM runs0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS words FROM documents),
grams0 AS (SELECT r, words, k, unnest(range(len(words) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM runs) WHERE len(words) >= k),
grams AS (SELECT r, k, pos, array_to_string(words[pos + 1 : pos + k], ' ') AS said FROM grams0),
hits AS (
    SELECT r, template, label, phrase, length, pos, place, pos - place AS diagonal, k FROM grams JOIN runs USING (k, said)
),
lines0 AS (
    SELECT r, template, label, length, diagonal, min(pos) AS first, max(pos + k - 1) AS last, list(DISTINCT place) AS places
    FROM hits GROUP BY ALL
),
lines1 AS (
    SELECT *, {_COVERED.format(places="places")} AS own,
        coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > 3, true)::INT AS apart
    FROM lines0
),
lines AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS band FROM lines1),
merged AS (
    SELECT r, label, length, min(first) AS first, max(last) AS last, max(own) AS best, list_distinct(flatten(list(places))) AS places
    FROM lines GROUP BY r, template, label, length, band
),
spans AS (
    SELECT r, label,
        (CASE WHEN last - first + 1 <= 2 * length THEN {_COVERED.format(places="places")} ELSE best END)::DOUBLE / length AS share
    FROM merged
),
found AS (SELECT r, max(share) AS score, list(label) AS labels FROM spans WHERE share >= 0.6 GROUP BY r),
base AS (
    SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels
    FROM hits WHERE phrase GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, array_to_string(coalesce(b.labels, []), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
    coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN found f USING (r)
"""

ORACLES = {
    "op6_pareto_mix": OP6,
    "op10_jump_shards": OP10,
    "op12_license_diagonals": OP12,
    "op13_merkle_manifest": OP13,
}

"""Pieces of DuckDB SQL that say the semantics of the operators independently of them."""

from __future__ import annotations

from motifel.functions.hashing import C1, C2, F1, F2, SEED

LETTERS, SPELLED = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
SEQ = f"seq AS (SELECT doc_id, source, lang, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{SPELLED}') AS seq FROM documents)"


def signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN ({x}::HUGEINT - 18446744073709551616)::BIGINT ELSE {x}::BIGINT END)"


def hexed(x: str) -> str:
    return f"lpad(upper(to_hex({x})), 16, '0')"


def times(x: str, factor: int) -> str:
    return f"((({x})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def plus(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def murmur(of: str, name: str, key: str, keep: str) -> str:
    """CTEs that end in ``name`` (keep..., h UBIGINT), the hash of key (UBIGINT) of ``of``."""
    both = SEED ^ 8
    out = [
        f"{name}_1 AS (SELECT {keep}, {times(key, C1)} AS a FROM {of})",
        f"{name}_2 AS (SELECT {keep}, {times(f'({times("a", 1 << 31)} | (a >> 33))', C2)} AS a FROM {name}_1)",
        f"{name}_3 AS (SELECT {keep}, {plus(f'xor(a, {both}::UBIGINT)', f'{both}::UBIGINT')} AS x FROM {name}_2)",
        f"{name}_4 AS (SELECT {keep}, x, {plus('x', f'{both}::UBIGINT')} AS y FROM {name}_3)",
        f"{name}_5 AS (SELECT {keep}, {times('xor(x, x >> 33)', F1)} AS x, {times('xor(y, y >> 33)', F1)} AS y FROM {name}_4)",
        f"{name}_6 AS (SELECT {keep}, {times('xor(x, x >> 33)', F2)} AS x, {times('xor(y, y >> 33)', F2)} AS y FROM {name}_5)",
        f"{name} AS (SELECT {keep}, {plus('xor(x, x >> 33)', 'xor(y, y >> 33)')} AS h FROM {name}_6)",
    ]
    return ", ".join(out)


def mers(m: int) -> str:
    """CTEs from seq to mer (doc_id, pos, c UBIGINT): the canonical m-mer at each place, from runs whose lengths double."""
    out = [
        "base AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS ch FROM seq WHERE length(seq) > 0)",
        "run1 AS (SELECT doc_id, pos, (strpos('ACTG', ch) - 1)::UBIGINT AS f1, xor((strpos('ACTG', ch) - 1)::UBIGINT, 2::UBIGINT) AS r1 FROM base)",
    ]
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"
    width, last = 1, "run1"
    while 2 * width <= m:
        n, s = 2 * width, 4**width
        out.append(f"run{n} AS (SELECT *, f{width} * {s}::UBIGINT + lead(f{width}, {width}) {w} AS f{n}, lead(r{width}, {width}) {w} * {s}::UBIGINT + r{width} AS r{n} FROM {last})")
        width, last = n, f"run{n}"
    have, f, r = 0, [], []
    for p in reversed(range(width.bit_length())):
        if m >> p & 1:
            n = 1 << p
            lead = lambda c: f"lead({c}{n}, {have}) {w}" if have else f"{c}{n}"  # noqa: B023, E731
            f.append(f"{lead('f')} * {4 ** (m - have - n)}::UBIGINT")
            r.append(f"{lead('r')} * {4**have}::UBIGINT")
            have += n
    out.append(f"strands AS (SELECT doc_id, pos, {' + '.join(f)} AS f, {' + '.join(r)} AS r FROM {last})")
    out.append("mer AS (SELECT doc_id, pos, least(f, r) AS c FROM strands WHERE f IS NOT NULL AND r IS NOT NULL)")
    return ", ".join(out)


def window_minima(k: int, m: int) -> str:
    """CTEs from documents to least_hash (doc_id, pos, mn): the minimizer of the k-mer at each place."""
    frame = f"OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {k - m} PRECEDING AND CURRENT ROW)"
    return f"{SEQ}, {mers(m)}, {murmur('mer', 'hashed', 'c', 'doc_id, pos')}, least_all AS (SELECT doc_id, pos, min(h) {frame} AS mn FROM hashed), least_hash AS (SELECT doc_id, pos - {k - m} AS pos, mn FROM least_all WHERE pos > {k - m})"


def kmer_digits(k: int) -> str:
    """CTEs from documents to kmer (doc_id, c): each canonical k-mer as digits of base 4, as text."""
    return f"""{SEQ}, digits AS (SELECT doc_id, translate(seq, 'ACTG', '0123') AS d, translate(reverse(seq), 'ACTG', '2301') AS e FROM seq WHERE length(seq) >= {k}),
        place AS (SELECT doc_id, d, e, unnest(range(1, length(d) - {k} + 2)) AS p FROM digits),
        kmer AS (SELECT doc_id, least(substr(d, p, {k}), substr(e, length(d) - p - {k} + 2, {k})) AS c FROM place)"""


def colored(pairs: str, n: str, name: str = "cs") -> str:
    """CTEs from a SELECT of (minimizer, color) and one of the number of colors: {name}_pairs, {name}_n and
    {name} (minimizer, w list of words as UBIGINT, colors list, n_set)."""
    return f"""{name}_pairs AS (SELECT DISTINCT minimizer::BIGINT AS minimizer, color::INT AS color FROM ({pairs})),
        {name}_n AS (SELECT n::INT AS n, ((n + 63) // 64)::INT AS nw FROM ({n})),
        {name}_word AS (SELECT minimizer, color // 64 AS i, bit_or(1::UBIGINT << (color % 64)) AS word FROM {name}_pairs GROUP BY ALL),
        {name}_all AS (SELECT minimizer, unnest(range(nw)) AS i FROM (SELECT DISTINCT minimizer FROM {name}_pairs), {name}_n),
        {name}_words AS (SELECT a.minimizer, list(coalesce(word, 0::UBIGINT) ORDER BY a.i) AS w FROM {name}_all a LEFT JOIN {name}_word b ON a.minimizer = b.minimizer AND a.i = b.i GROUP BY 1),
        {name}_list AS (SELECT minimizer, list(color ORDER BY color) AS colors, count(*)::INT AS n_set FROM {name}_pairs GROUP BY 1),
        {name} AS (SELECT minimizer, w, colors, n_set FROM {name}_words JOIN {name}_list USING (minimizer))"""


WORDS_HEX = "list_aggregate(list_transform(w, lambda x: lpad(upper(to_hex(x)), 16, '0')), 'string_agg', '')"
SWAPPED_HEX = "list_aggregate(list_transform(w, lambda x: " + " || ".join(f"substr(lpad(upper(to_hex(x)), 16, '0'), {i}, 2)" for i in range(15, 0, -2)) + "), 'string_agg', '')"


def joined(colors: str = "colors", by: str = ",") -> str:
    return f"list_aggregate(list_transform({colors}, lambda x: x::VARCHAR), 'string_agg', '{by}')"


def layout(n: str, words: str) -> str:
    """Columns width, per_word, threshold from the number of colors and of words."""
    width = f"(CASE WHEN {n} - 1 < 256 THEN 8 WHEN {n} - 1 < 65536 THEN 16 ELSE 32 END)"
    return f"{width} AS width, 64 // {width} AS per_word, ({words} - 1) * (64 // {width}) - 1 AS threshold"


def packed(rows: str, name: str = "packed") -> str:
    """CTE from rows (minimizer, colors, width, per_word) to (minimizer, packed hex)."""
    return f"""{name}_fields AS (SELECT minimizer, width, per_word, unnest(list_prepend(len(colors)::INT, colors)) AS field, unnest(range(len(colors) + 1)) AS i FROM {rows}),
        {name}_words AS (SELECT minimizer, i // per_word AS word, bit_or(field::UBIGINT << ((per_word - 1 - i % per_word) * width)) AS x FROM {name}_fields GROUP BY ALL),
        {name} AS (SELECT minimizer, string_agg({hexed('x')}, '' ORDER BY word) AS packed FROM {name}_words GROUP BY 1)"""

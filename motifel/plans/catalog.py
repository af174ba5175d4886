"""Every operator as a query over the tables, with its SQL.

The tables hold no sequences: prose is read as pseudo-DNA (dna.pseudo_dna), and colored sets come
from keys of the other tables (minimizer l_partkey, color l_suppkey). Bitmaps, lists and hashes are
shown as text, so that no client has to agree about unsigned numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.functions import dna, hashing
from motifel.operators import colors, extract, merge, order, stats
from motifel.plans import sql
from motifel.plans.index import index_records
from motifel.sources import fastx, rawmini, storage
from motifel.sources.generated import generated_sets
from motifel.sources.scratch import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sequences -----------------------------------------------------------------------------


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "source", dna.pseudo_dna(F.col("text")).alias("seq"))


@query("""WITH c AS (SELECT doc_id, regexp_extract_all(translate(text, 'acgtuU' || chr(10), 'ACGTTT'), '[ACGT]+') AS f FROM documents)
    SELECT doc_id, (unnest(range(len(f))))::INT AS frag_id, unnest(f) AS seq FROM c""")
def seq_fragments(spark, sf_dir):
    return extract.seq_fragments(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("seq")))


@query(f"WITH {sql.SEQ}, p AS (SELECT substr(seq, unnest(range(1, length(seq) - 6)), 8) AS kmer FROM seq WHERE length(seq) >= 8) SELECT kmer, " + " + ".join(f"(strpos('ACTG', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (7 - i)}" for i in range(8)) + " AS code, count(*) AS cnt FROM p GROUP BY kmer")
def kmer_encode(spark, sf_dir):
    p = extract.pieces(_sequences(spark, sf_dir), [], 8).withColumnRenamed("mer", "kmer")
    return p.groupBy("kmer").agg(F.count("*").alias("cnt")).select("kmer", dna.encode(F.col("kmer"), 8).alias("code"), "cnt")


_DIGIT = " || ".join(f"substr('ACTG', (((k >> {2 * i}) & 3) + 1)::INT, 1)" for i in range(30, -1, -1))


@query(f"SELECT k AS value, {_DIGIT} AS kmer FROM (SELECT DISTINCT o_orderkey * 1000003 + o_custkey AS k FROM orders)")
def kmer_decode(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1000003 + F.col("o_custkey")).alias("value")).distinct()
    return o.select("value", dna.decode(F.col("value"), 31).alias("kmer"))


@query(f"WITH {sql.SEQ} SELECT doc_id, translate(reverse(seq), 'ACTG', 'TGAC') AS rc FROM seq")
def revcomp(spark, sf_dir):
    return _sequences(spark, sf_dir).select("doc_id", dna.revcomp(F.col("seq")).alias("rc"))


@query(f"WITH {sql.kmer_digits(31)} SELECT doc_id, count(*) AS n_kmers, count(DISTINCT c) AS n_canonical, translate(min(c), '0123', 'ACTG') AS first_kmer, translate(max(c), '0123', 'ACTG') AS last_kmer FROM kmer GROUP BY doc_id")
def canonical_kmers(spark, sf_dir):
    found = extract.counted_kmers(_sequences(spark, sf_dir), ["doc_id"], 31)  # 62 bits: no sign to mind
    per = found.groupBy("doc_id").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_canonical"), F.min("kmer").alias("a"), F.max("kmer").alias("z"))
    return per.select("doc_id", "n_kmers", "n_canonical", dna.decode(F.col("a"), 31).alias("first_kmer"), dna.decode(F.col("z"), 31).alias("last_kmer"))


@query(f"WITH {sql.kmer_digits(9)} SELECT translate(c, '0123', 'ACTG') AS kmer, count(*) AS cnt FROM kmer GROUP BY c")
def kmer_count(spark, sf_dir):
    return extract.counted_kmers(_sequences(spark, sf_dir), [], 9).select(dna.decode(F.col("kmer"), 9).alias("kmer"), F.col("n").alias("cnt"))


@query(f"WITH {sql.kmer_digits(27)} SELECT (SELECT count(seq) FROM seq) AS n_sequences, (SELECT count(*) FROM kmer) AS n_kmers, (SELECT count(DISTINCT c) FROM kmer) AS n_unique, 0::BIGINT AS n_invalid")
def kmer_stats(spark, sf_dir):
    return extract.kmer_stats(_sequences(spark, sf_dir), 27)


@query("""WITH c AS (SELECT text, translate(text, 'acgtuU' || chr(10), 'ACGTTT') AS s FROM documents),
    f AS (SELECT unnest(regexp_extract_all(s, '[ACGT]+')) AS f FROM c),
    p AS (SELECT translate(f, 'ACTG', '0123') AS d, translate(reverse(f), 'ACTG', '2301') AS e, unnest(range(1, length(f) - 1)) AS p FROM f WHERE length(f) >= 3),
    k AS (SELECT least(substr(d, p, 3), substr(e, length(d) - p - 1, 3)) AS c FROM p)
    SELECT (SELECT count(text) FROM c) AS n_sequences, (SELECT count(*) FROM k) AS n_kmers, (SELECT count(DISTINCT c) FROM k) AS n_unique,
      (SELECT sum(length(s) - length(regexp_replace(s, '[^ACGT]', '', 'g')))::BIGINT FROM c) AS n_invalid""")
def kmer_stats_of_text(spark, sf_dir):
    """Prose as it is: nearly all of it breaks fragments."""
    return extract.kmer_stats(_table(spark, sf_dir, "documents").select(F.col("text").alias("seq")), 3)


@query(f"WITH o AS (SELECT DISTINCT o_orderkey FROM orders), k AS (SELECT o_orderkey, o_orderkey::UBIGINT AS c FROM o), {sql.murmur('k', 'hashed', 'c', 'o_orderkey')} SELECT o_orderkey, {sql.hexed('h')} AS hash FROM hashed")
def murmur_hash(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return hashing.murmur(o, "o_orderkey", "h").select("o_orderkey", b.hex16(F.col("h")).alias("hash"))


def _wang_sql(key: str, n: int) -> str:
    mask = (1 << n) - 1
    steps, last = [], "w0"
    exprs = [f"(({key} * 2097151 - 1) % {1 << n} + {1 << n}) % {1 << n}", "xor(x, x >> 24)", f"(x * 265) % {1 << n}", "xor(x, x >> 14)", f"(x * 21) % {1 << n}", "xor(x, x >> 28)", f"(x * 2147483649) % {1 << n}"]
    for i, e in enumerate(exprs):
        steps.append(f"w{i + 1} AS (SELECT o_orderkey, ({e})::HUGEINT AS x FROM {last})")
        last = f"w{i + 1}"
    return f"w0 AS (SELECT DISTINCT o_orderkey, (o_orderkey & {mask})::HUGEINT AS x FROM orders), " + ", ".join(steps)


@query(f"WITH {_wang_sql('x', 38)} SELECT o_orderkey, x::BIGINT AS hash FROM w7")
def wang_hash(spark, sf_dir):
    return hashing.wang(_table(spark, sf_dir, "orders").select("o_orderkey").distinct(), "o_orderkey", "hash", 38)


@query("SELECT DISTINCT o_orderkey, o_orderkey AS back FROM orders")
def wang_roundtrip(spark, sf_dir):
    hashed = hashing.wang(_table(spark, sf_dir, "orders").select("o_orderkey").distinct(), "o_orderkey", "hash", 62)
    return hashing.wang_inverse(hashed, "hash", "back", 62).select("o_orderkey", "back")


# --- window hashes ----------------------------------------------------------------------------

K, M = extract.K, extract.M
_LEAST = sql.window_minima(K, M)


@query(f"WITH {_LEAST} SELECT DISTINCT doc_id, {sql.hexed('mn')} AS minimizer FROM least_hash")
def minimizer_doc(spark, sf_dir):
    return extract.minimizer_hashes(_sequences(spark, sf_dir), ["doc_id"], K, M).select("doc_id", b.hex16(F.col("minimizer")).alias("minimizer"))


@query(f"WITH {_LEAST} SELECT DISTINCT {sql.hexed('mn')} AS minimizer FROM least_hash")
def minimizer_set(spark, sf_dir):
    return extract.minimizer_hashes(_sequences(spark, sf_dir), [], K, M).select(b.hex16(F.col("minimizer")).alias("minimizer"))


@query(f"WITH {_LEAST}, l AS (SELECT doc_id, pos, mn, lag(mn) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM least_hash) SELECT doc_id, pos, {sql.hexed('mn')} AS minimizer FROM l WHERE before IS NULL OR before <> mn")
def minimizer_runs(spark, sf_dir):
    placed = extract.placed_hashes(_sequences(spark, sf_dir), ["doc_id"], K, M, runs=True)
    return placed.select("doc_id", "pos", b.hex16(F.col("minimizer")).alias("minimizer"))


@query(f"WITH {_LEAST} SELECT doc_id, count(*) AS n, {sql.hexed('min(mn)')} AS least, {sql.hexed('max(mn)')} AS greatest, {sql.hexed('bit_xor(mn)')} AS mixed FROM least_hash GROUP BY doc_id")
def window_min(spark, sf_dir):
    """By window functions alone; minimizer_runs is the kernel's way."""
    placed = extract.window_hashes(_sequences(spark, sf_dir).select("doc_id", "seq"), ["doc_id"], K, M)
    key = b.unsigned_key(F.col("minimizer"))
    agg = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("z"), F.bit_xor("minimizer").alias("x"))
    return agg.select("doc_id", "n", b.hex16(b.unsigned_key(F.col("a"))).alias("least"), b.hex16(b.unsigned_key(F.col("z"))).alias("greatest"), b.hex16(F.col("x")).alias("mixed"))


def _source_index(spark, sf_dir):
    """The index of all documents, a source being a color."""
    s = _sequences(spark, sf_dir)
    dim = colors.color_dimension(s, "source")
    n = dim.count()
    records = s.join(colors.small(dim), s.source.eqNullSafe(dim.file)).select(F.col("color_id").alias("color"), "seq")  # the list of sources
    return index_records(records, dim, n)


_RANKED = f"{_LEAST}, ranked AS (SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS color FROM documents)"


@query(f"WITH {_RANKED}, p AS (SELECT DISTINCT mn, color FROM least_hash JOIN ranked USING (doc_id)), k AS (SELECT mn, count(*)::INT AS n_colors FROM p GROUP BY mn), g AS (SELECT n_colors, count(*) AS occurrences FROM k GROUP BY 1) SELECT n_colors, occurrences, 100.0 * occurrences / sum(occurrences) OVER () AS percent, 100.0 * sum(occurrences) OVER (ORDER BY n_colors) / sum(occurrences) OVER () AS cumulative FROM g")
def color_index_histogram(spark, sf_dir):
    return stats.color_histogram(_source_index(spark, sf_dir).rows())


@query(f"WITH {_RANKED} SELECT {sql.hexed('mn')} AS minimizer, {sql.hexed('bit_or(1::UBIGINT << color)')} AS w0 FROM least_hash JOIN ranked USING (doc_id) GROUP BY mn")
def color_index_rows(spark, sf_dir):
    """A column for each 64 sources: w0, w1 and so on."""
    index = _source_index(spark, sf_dir)
    words = [b.hex16(F.col("color_words")[i]).alias(f"w{i}") for i in range(b.words_needed(index.n_colors))]
    return index.rows().select(b.hex16(F.col("minimizer")).alias("minimizer"), *words)


# --- colored sets --------------------------------------------------------------------------

_FULL = "SELECT l_partkey AS minimizer, l_suppkey AS color FROM lineitem"
_FIRST, _SECOND = f"{_FULL} WHERE l_linenumber = 1", f"{_FULL} WHERE l_linenumber = 2"
_N = "SELECT max(l_suppkey) + 1 AS n FROM lineitem"


def _pairs(spark, sf_dir, line: int | None = None) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    li = li.where(F.col("l_linenumber") == line) if line else li
    return li.select(F.col("l_partkey").alias("minimizer"), F.col("l_suppkey").cast("int").alias("color")).distinct()


def _n(spark, sf_dir) -> int:
    return colors.color_count(_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("color")))


def _rows(spark, sf_dir, line: int | None = None) -> tuple[DataFrame, int]:
    n = _n(spark, sf_dir)
    return colors.color_words(_pairs(spark, sf_dir, line), n), n


def _nonzero(spark, sf_dir) -> tuple[DataFrame, int]:
    """The same rows by their words that are not 0."""
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("minimizer"), F.col("l_suppkey").cast("int").alias("color"))
    return colors.nonzero_rows(li), _n(spark, sf_dir)


def _listed(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


_hex = lambda: b.words_hex(F.col("color_words")).alias("words")


@query("WITH r AS (SELECT DISTINCT user_id, dense_rank() OVER (ORDER BY event_type) - 1 AS c FROM events) SELECT user_id AS minimizer, bit_or(1::BIGINT << c::INT) AS w0 FROM r GROUP BY 1")
def color_bitmap(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    dim = colors.color_dimension(e, "event_type")
    return colors.color_bitmap(e.join(colors.small(dim), e.event_type == dim.file).select(F.col("user_id").alias("minimizer"), F.col("color_id").alias("color")))  # the list of types


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def color_bitmap_wide(spark, sf_dir):
    return _rows(spark, sf_dir)[0].select("minimizer", _hex())


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, n_set AS n_colors FROM cs")
def color_popcount(spark, sf_dir):
    return _rows(spark, sf_dir)[0].select("minimizer", b.popcount(F.col("color_words")).alias("n_colors"))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, {sql.joined()} AS colors FROM cs")
def bitmap_to_list(spark, sf_dir):
    rows, n = _rows(spark, sf_dir)
    return rows.select("minimizer", _listed(b.to_list(F.col("color_words"), n)).alias("colors"))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def list_to_bitmap(spark, sf_dir):
    return colors.color_lists(_pairs(spark, sf_dir)).select("minimizer", b.words_hex(b.from_list(F.col("colors"), _n(spark, sf_dir))).alias("words"))


_LAYOUT, _LAYOUT_FULL = (f"WITH {sql.colored(x, _N)}, laid AS (SELECT cs.*, n, {sql.layout('n', 'nw')} FROM cs, cs_n)" for x in (_FIRST, _FULL))


@query(f"{_LAYOUT} SELECT minimizer, {sql.WORDS_HEX} AS words FROM laid WHERE n <= 64 OR n_set > threshold")
def split_dense(spark, sf_dir):
    rows, n = _rows(spark, sf_dir, 1)
    return colors.split_dense(rows, b.SparseLayout(n)).select("minimizer", _hex())


@query(f"{_LAYOUT}, few AS (SELECT * FROM laid WHERE n > 64 AND n_set <= threshold), {sql.packed('few')} SELECT f.minimizer, {sql.joined()} AS colors, packed FROM few f JOIN packed USING (minimizer)")
def split_sparse(spark, sf_dir):
    rows, n = _rows(spark, sf_dir, 1)
    return colors.split_sparse(rows, b.SparseLayout(n)).select("minimizer", _listed(F.col("colors")).alias("colors"), b.words_hex(F.col("packed")).alias("packed"))


@query(f"{_LAYOUT_FULL}, {sql.packed('laid')} SELECT minimizer, packed FROM packed")
def sparse_pack(spark, sf_dir):
    """All lists packed, however long."""
    layout = b.SparseLayout(_n(spark, sf_dir))
    lists = colors.color_lists(_pairs(spark, sf_dir))
    return lists.select("minimizer", b.words_hex(b.sparse_pack(F.col("colors"), layout)).alias("packed"))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, {sql.joined()} AS colors FROM cs")
def sparse_unpack(spark, sf_dir):
    layout = b.SparseLayout(_n(spark, sf_dir))
    packed = colors.color_lists(_pairs(spark, sf_dir)).select("minimizer", b.sparse_pack(F.col("colors"), layout).alias("packed"))
    return packed.select("minimizer", _listed(b.sparse_unpack(F.col("packed"), layout)).alias("colors"))


@query(f"SELECT n_colors, width, per_word, words, (words - 1) * per_word - 1 AS threshold FROM (SELECT i::INT AS n_colors, (CASE WHEN i - 1 < 256 THEN 8 WHEN i - 1 < 65536 THEN 16 ELSE 32 END)::INT AS width, (64 // (CASE WHEN i - 1 < 256 THEN 8 WHEN i - 1 < 65536 THEN 16 ELSE 32 END))::INT AS per_word, ((i + 63) // 64)::INT AS words FROM (SELECT unnest(range(1, 70001, 7)) AS i))")
def sparse_layouts(spark, sf_dir):
    rows = [(n, s.width, s.per_word, s.words, s.threshold) for n in range(1, 70001, 7) for s in [b.SparseLayout(n)]]
    return spark.createDataFrame(rows, "n_colors int, width int, per_word int, words int, threshold int")


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer FROM cs_pairs WHERE color = 7")
def extract_color(spark, sf_dir):
    rows, n = _rows(spark, sf_dir)
    return colors.extract_color(rows, 7, n)


@query(f"WITH {sql.colored(_FULL, _N)} SELECT color, minimizer FROM cs_pairs")
def extract_all_colors(spark, sf_dir):
    return colors.as_pairs(*_rows(spark, sf_dir))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer & 4294967295 AS lo, minimizer >> 32 AS hi, n_set AS n_colors, {sql.joined()} AS colors FROM cs")
def color_index(spark, sf_dir):
    return colors.color_index(*_rows(spark, sf_dir)).withColumn("colors", _listed(F.col("colors")))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT row_number() OVER (ORDER BY minimizer) - 1 AS idx, {sql.hexed('minimizer')} AS hex, {sql.WORDS_HEX} AS words, {sql.joined(by=' ')} AS colors FROM cs")
def raw_dump(spark, sf_dir):
    rows, n = _nonzero(spark, sf_dir)
    numbered = order.ordinal(rows, b.hex16(F.col("minimizer")))
    return colors.raw_dump(numbered, n, "idx").drop("minimizer")


@query("SELECT upper(lpad(to_hex(k), 16, '0')) AS hex FROM (SELECT DISTINCT o_orderkey AS k FROM orders)")
def minimizer_hex(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey").distinct().select(b.hex16(F.col("o_orderkey")).alias("hex"))


@query(f"WITH {sql.colored(_FULL, _N)}, g AS (SELECT n_set AS n_colors, count(*) AS occurrences FROM cs GROUP BY 1) SELECT n_colors, occurrences, 100.0 * occurrences / sum(occurrences) OVER () AS percent, 100.0 * sum(occurrences) OVER (ORDER BY n_colors) / sum(occurrences) OVER () AS cumulative FROM g")
def color_histogram(spark, sf_dir):
    return stats.color_histogram(_rows(spark, sf_dir)[0])


@query(f"WITH {sql.colored(_FULL, _N)} SELECT count(*) AS n_keys, count(*) * (1 + any_value(nw)) AS n_words, sum(n_set)::BIGINT AS n_pairs, sum(n_set)::DOUBLE / count(*) AS mean_colors, count(*) * (1 + any_value(nw)) * 8 AS file_bytes, count(*) * 24 + sum(n_set)::BIGINT * 2 AS ram_bytes FROM cs, cs_n")
def color_summary(spark, sf_dir):
    return stats.color_summary(*_rows(spark, sf_dir))


# --- merges --------------------------------------------------------------------------------


def _customers(spark, sf_dir, status: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("minimizer")).distinct()


_STATUS = "(SELECT DISTINCT o_custkey AS minimizer FROM orders WHERE o_orderstatus = '{}')"
_A, _B, _C = (_STATUS.format(x) for x in "FOP")


@query(f"SELECT minimizer FROM {_A} UNION SELECT minimizer FROM {_B}")
def merge_plain(spark, sf_dir):
    return merge.merge_plain(_customers(spark, sf_dir, "F"), _customers(spark, sf_dir, "O"))


@query(f"SELECT minimizer FROM {_A} UNION SELECT minimizer FROM {_B} UNION SELECT minimizer FROM {_C}")
def merge_n_plain(spark, sf_dir):
    return merge.merge_plain(*[_customers(spark, sf_dir, x) for x in "FOP"])


@query("SELECT DISTINCT o_custkey AS minimizer FROM orders")
def distinct_keys(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("minimizer")).distinct()


@query(f"SELECT minimizer, 1::BIGINT AS w0 FROM {_A}")
def color_single(spark, sf_dir):
    return merge.color_single(_customers(spark, sf_dir, "F")).select("minimizer", F.col("color_words")[0].alias("w0"))


@query(f"SELECT coalesce(a.minimizer, b.minimizer) AS minimizer, (CASE WHEN a.minimizer IS NULL THEN 0 ELSE 1 END + CASE WHEN b.minimizer IS NULL THEN 0 ELSE 2 END)::BIGINT AS w0 FROM {_A} a FULL JOIN {_B} b ON a.minimizer = b.minimizer")
def merge_two(spark, sf_dir):
    one = [merge.color_single(_customers(spark, sf_dir, x)) for x in "FO"]
    return merge.merge_two_colored(*one, 1, 1).select("minimizer", F.col("color_words")[0].alias("w0"))


@query(f"WITH u AS (SELECT minimizer, 1 AS w FROM {_A} UNION ALL SELECT minimizer, 2 FROM {_B} UNION ALL SELECT minimizer, 4 FROM {_C}) SELECT minimizer, bit_or(w)::BIGINT AS w0 FROM u GROUP BY 1")
def merge_n_colored(spark, sf_dir):
    return colors.color_bitmap(merge.merge_n(*[_customers(spark, sf_dir, x) for x in "FOP"]))


@query(f"WITH u AS (SELECT minimizer FROM {_A} UNION ALL SELECT minimizer FROM {_B} UNION ALL SELECT minimizer FROM {_C}) SELECT count(*) AS n_start, count(*) - count(DISTINCT minimizer) AS n_skipped, count(DISTINCT minimizer) AS n_final FROM u")
def merge_report(spark, sf_dir):
    return merge.merge_report(*[_customers(spark, sf_dir, x) for x in "FOP"])


_LINES = "SELECT l_partkey AS minimizer, l_linenumber - 1 AS color FROM lineitem"
_FLAGS = "SELECT l_partkey AS minimizer, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS color FROM lineitem"


def _behind(left: str, right: str, nl: str, nr: str) -> str:
    """The colors of right behind those of left: from the next one on if 64 hold all, else from a new word on."""
    start = f"(CASE WHEN {nl} + {nr} <= 64 THEN {nl} ELSE 64 * (({nl} + 63) // 64) END)"
    total = f"(CASE WHEN {nl} + {nr} <= 64 THEN {nl} + {nr} ELSE 64 * (({nl} + 63) // 64 + ({nr} + 63) // 64) END)"
    return sql.colored(f"SELECT minimizer, color FROM ({left}) UNION ALL SELECT minimizer, color + {start} FROM ({right})", f"SELECT {total} AS n")


def _line_rows(spark, sf_dir) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("minimizer"), (F.col("l_linenumber") - 1).alias("color"))
    return colors.color_words(li, 7)


def _flag_rows(spark, sf_dir) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    dim = colors.color_dimension(li, "l_returnflag")
    return colors.color_words(li.join(colors.small(dim), li.l_returnflag == dim.file).select(F.col("l_partkey").alias("minimizer"), F.col("color_id").alias("color")), 3)  # three flags


@query(f"WITH {_behind(_LINES, _FLAGS, '7', '3')} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def merge_shift(spark, sf_dir):
    return merge.merge_two_colored(_line_rows(spark, sf_dir), _flag_rows(spark, sf_dir), 7, 3).select("minimizer", _hex())


@query(f"WITH {_behind(_LINES, f'SELECT minimizer, 0 AS color FROM {_A}', '7', '1')} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def merge_colored_plain(spark, sf_dir):
    return merge.merge_two_colored(_line_rows(spark, sf_dir), merge.color_single(_customers(spark, sf_dir, "F")), 7, 1).select("minimizer", _hex())


_MAX = "(SELECT max(l_suppkey) + 1 FROM lineitem)"


@query(f"WITH {_behind(_FIRST, _SECOND, _MAX, _MAX)} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def merge_concat(spark, sf_dir):
    left, n = _rows(spark, sf_dir, 1)
    return merge.merge_two_colored(left, _rows(spark, sf_dir, 2)[0], n, n).select("minimizer", _hex())


@query(f"WITH {_behind(_FIRST, _FLAGS, _MAX, '3')} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def merge_unequal(spark, sf_dir):
    left, n = _rows(spark, sf_dir, 1)
    return merge.merge_two_colored(left, _flag_rows(spark, sf_dir), n, 3).select("minimizer", _hex())


_WORDS = f"(({_MAX} + 63) // 64)"


@query(f"WITH {sql.colored(f'SELECT minimizer, color FROM ({_FIRST}) UNION ALL SELECT minimizer, color + 64 * {_WORDS} FROM ({_LINES}) UNION ALL SELECT minimizer, color + 64 * (2 * {_WORDS} + 1) FROM ({_FLAGS}) UNION ALL SELECT minimizer, color + 64 * ({_WORDS} + 1) FROM ({_SECOND})', f'SELECT 64 * (2 * {_WORDS} + 2) AS n')} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def merge_n_words(spark, sf_dir):
    """Four colored sets of unequal numbers of words in one merge."""
    first, n = _rows(spark, sf_dir, 1)
    return merge.merge_n_words((first, n), (_line_rows(spark, sf_dir), 7), (_rows(spark, sf_dir, 2)[0], n), (_flag_rows(spark, sf_dir), 3)).select("minimizer", _hex())


_HEAD, _TAIL = f"{_FULL} WHERE l_linenumber <= 3", f"{_FULL} WHERE l_linenumber > 3"
_FINAL = f"""WITH {_behind(_HEAD, _TAIL, _MAX, _MAX)}, two AS (SELECT {_MAX}::INT AS one, 2 * {_MAX}::INT AS n),
    laid AS (SELECT cs.*, one, two.n AS total, {sql.layout('two.n', '(2 * ((one + 63) // 64))')} FROM cs, two)"""


def _final(spark, sf_dir):
    n = _n(spark, sf_dir)
    li = _table(spark, sf_dir, "lineitem")
    half = lambda x: colors.nonzero_rows(li.where(x).select(F.col("l_partkey").alias("minimizer"), F.col("l_suppkey").cast("int").alias("color")))
    return merge.merge_final(half("l_linenumber <= 3"), half("l_linenumber > 3"), n, n)


@query(f"{_FINAL} SELECT minimizer, {sql.WORDS_HEX} AS words FROM laid WHERE total <= 64 OR n_set > threshold")
def merge_final_dense(spark, sf_dir):
    return _final(spark, sf_dir)[0].select("minimizer", _hex())


@query(f"{_FINAL}, few AS (SELECT minimizer, width, per_word, list_transform(colors, lambda c: (CASE WHEN c < one THEN c ELSE c - 64 * ((one + 63) // 64) + one END)::INT) AS colors FROM laid WHERE total > 64 AND n_set <= threshold), {sql.packed('few')} SELECT f.minimizer, {sql.joined()} AS colors, packed FROM few f JOIN packed USING (minimizer)")
def merge_final_sparse(spark, sf_dir):
    return _final(spark, sf_dir)[1].select("minimizer", _listed(F.col("colors")).alias("colors"), b.words_hex(F.col("packed")).alias("packed"))


# --- orders --------------------------------------------------------------------------------


@query(f"WITH {sql.colored(_FULL, _N)} SELECT row_number() OVER (ORDER BY {sql.SWAPPED_HEX}, minimizer) - 1 AS idx, minimizer, {sql.WORDS_HEX} AS words FROM cs")
def sort_dense(spark, sf_dir):
    rows, _ = _rows(spark, sf_dir)
    return order.ordinal(rows, order.dense_key(F.col("color_words"), F.col("minimizer"))).select("idx", "minimizer", _hex())


@query(f"WITH {sql.colored(_FULL, _N)} SELECT row_number() OVER (ORDER BY n_set, colors, minimizer) - 1 AS idx, minimizer, {sql.joined()} AS colors FROM cs")
def sort_sparse(spark, sf_dir):
    lists = colors.color_lists(_pairs(spark, sf_dir))
    return order.ordinal(lists, order.sparse_key(F.col("colors"), F.col("minimizer"))).select("idx", "minimizer", _listed(F.col("colors")).alias("colors"))


@query(f"WITH o AS (SELECT DISTINCT o_orderkey FROM orders), k AS (SELECT o_orderkey, o_orderkey::UBIGINT AS c FROM o), {sql.murmur('k', 'hashed', 'c', 'o_orderkey')} SELECT row_number() OVER (ORDER BY h) - 1 AS idx, {sql.hexed('h')} AS hash FROM hashed")
def sort_unsigned(spark, sf_dir):
    hashed = hashing.murmur(_table(spark, sf_dir, "orders").select("o_orderkey").distinct(), "o_orderkey", "h").select(b.hex16(F.col("h")).alias("hash"))
    return order.ordinal(hashed, F.col("hash")).select("idx", "hash")


@query(f"WITH {sql.colored(_FULL, _N)} SELECT count(*) AS n_rows, 0::BIGINT AS n_violations FROM cs")
def check_sorted(spark, sf_dir):
    rows, _ = _nonzero(spark, sf_dir)
    key = order.dense_key_of(F.col("nonzero"), F.col("minimizer"))
    return order.check_sorted(order.ordinal(rows, key), key, "idx")


@query(f"WITH {sql.colored(_FULL, _N)}, k AS (SELECT minimizer, {sql.SWAPPED_HEX} AS key FROM cs), l AS (SELECT key, lag(key) OVER (ORDER BY minimizer) AS before FROM k) SELECT count(*) AS n_rows, count(*) FILTER (WHERE before > key) AS n_violations FROM l")
def check_unsorted(spark, sf_dir):
    """The same check over rows in the order of window hashes, which is another one."""
    rows, _ = _rows(spark, sf_dir)
    numbered = order.ordinal(rows, b.hex16(F.col("minimizer")))
    return order.check_sorted(numbered, F.array_join(F.transform("color_words", lambda w: b.hex16(b.byte_swapped(w))), ""), "idx")


@query(f"WITH {sql.colored(_FULL, _N)}, o AS (SELECT row_number() OVER (ORDER BY minimizer) - 1 AS ordinal, {sql.WORDS_HEX} AS words FROM cs) SELECT row_number() OVER (ORDER BY words, ordinal DESC) - 1 AS idx, ordinal, words FROM o")
def color_sorter(spark, sf_dir):
    rows, n = _nonzero(spark, sf_dir)
    return order.color_sorter(rows).select("idx", "ordinal", b.nonzero_hex(F.col("nonzero"), b.words_needed(n)).alias("words"))


def _top_sql(way: str) -> str:
    return f"WITH {sql.colored(_FULL, _N)}, t AS (SELECT * FROM cs ORDER BY n_set {way}, colors {way}, minimizer {way} LIMIT 16) SELECT minimizer, n_set AS n_colors, {sql.joined()} AS colors FROM t"


def _top(spark, sf_dir, smallest: bool) -> DataFrame:
    lists = order.color_top(colors.color_lists(_pairs(spark, sf_dir)), 16, smallest)
    return lists.select("minimizer", F.size("colors").alias("n_colors"), _listed(F.col("colors")).alias("colors"))


@query(_top_sql("ASC"))
def color_topk(spark, sf_dir):
    return _top(spark, sf_dir, True)


@query(_top_sql("DESC"))
def color_bottomk(spark, sf_dir):
    return _top(spark, sf_dir, False)


@query(f"WITH a AS (SELECT minimizer, row_number() OVER (ORDER BY minimizer) - 1 AS idx FROM {_A}), b AS (SELECT minimizer, row_number() OVER (ORDER BY minimizer) - 1 AS idx FROM {_B}), j AS (SELECT idx, a.minimizer AS a, b.minimizer AS b FROM a JOIN b USING (idx)), f AS (SELECT min(idx) AS f FROM j WHERE a <> b) SELECT idx, a, b, a = b AS same FROM j, f WHERE idx BETWEEN f - 16 AND f + 15")
def raw_compare(spark, sf_dir):
    a, c = (order.ordinal(_customers(spark, sf_dir, x), b.hex16(F.col("minimizer"))) for x in "FO")
    return order.raw_compare(a, c)


# --- reports, extensions -------------------------------------------------------------------


@query("SELECT sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines FROM documents")
def line_count(spark, sf_dir):
    return stats.line_count(_table(spark, sf_dir, "documents"), "text")


@query("SELECT length(string_split(text, chr(9))[1])::INT AS k FROM documents ORDER BY doc_id LIMIT 1")
def first_value_length(spark, sf_dir):
    return stats.first_value_length(_table(spark, sf_dir, "documents").orderBy("doc_id"), "text")


@query("SELECT count(DISTINCT c_nationkey) AS n_files, 8 * count(*) AS n_bytes, 8 * count(*) // 1024 AS n_kbytes, 8 * count(*) // 1048576 AS n_mbytes FROM customer")
def file_totals(spark, sf_dir):
    """Of flat files, one for each nation, that hold its customers."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("minimizer"), F.col("c_nationkey").cast("int").alias("part"))
    n = customers.agg(F.max("part")).first()[0] or 0
    path = shared_path(spark, "nations")
    rawmini.write_raw(customers.repartitionById(n + 1, F.col("part")), path)
    return stats.file_totals(spark.createDataFrame([(size,) for _, size in storage.listing(spark, path)], "length long"))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer FROM cs_pairs WHERE color IN (1, 3) GROUP BY 1 HAVING count(*) = 2")
def ext_intersect(spark, sf_dir):
    rows, n = _rows(spark, sf_dir)
    return colors.ext_intersect(rows, [1, 3], n)


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer FROM cs_pairs WHERE color = 1 EXCEPT SELECT minimizer FROM cs_pairs WHERE color = 3")
def ext_except(spark, sf_dir):
    rows, n = _rows(spark, sf_dir)
    return colors.ext_except(rows, [1], [3], n)


@query(f"WITH {sql.colored(_LINES, 'SELECT 7 AS n')}, s AS (SELECT color, count(*) AS n FROM cs_pairs GROUP BY 1), j AS (SELECT x.color AS a, y.color AS b, count(*) AS n_both FROM cs_pairs x JOIN cs_pairs y ON x.minimizer = y.minimizer AND x.color < y.color GROUP BY ALL) SELECT a, b, n_both, n_both::DOUBLE / (s.n + t.n - n_both) AS jaccard FROM j JOIN s ON a = s.color JOIN s t ON b = t.color")
def ext_jaccard(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("minimizer"), (F.col("l_linenumber") - 1).alias("color")).distinct()
    return colors.ext_jaccard(li, 7)


# --- sources and sinks ---------------------------------------------------------------------


@query(f"WITH {sql.SEQ} SELECT doc_id::VARCHAR AS header, length(seq) AS n_bases, md5(seq) AS digest FROM seq")
def fasta_roundtrip(spark, sf_dir):
    """All sequences written as compressed FASTA in lines of 70 bases and read again."""
    path = shared_path(spark, "fasta")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("seq") / 70).cast("int")), lambda i: F.substring(F.col("seq"), i * 70 + 1, F.lit(70))), "\n")
    _sequences(spark, sf_dir).select(F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), lines).alias("value")).write.option("compression", "gzip").text(path)
    back = fastx.read_fasta(spark, path)
    return back.select("header", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


_BACK = f"WITH {sql.SEQ} SELECT doc_id::VARCHAR AS header, length(seq) AS n_bases, md5(seq) AS digest FROM seq WHERE seq IS NOT NULL"


def _digested(back: DataFrame) -> DataFrame:
    return back.select("header", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


def _fastq(spark, sf_dir) -> DataFrame:
    """Each sequence as a record of four lines, its quality a run of @."""
    s = _sequences(spark, sf_dir).where("seq IS NOT NULL")
    return s.select(F.concat(F.lit("@"), F.col("doc_id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.regexp_replace("seq", ".", "@")).alias("value"))


@query(_BACK)
def fastq_roundtrip(spark, sf_dir):
    """All sequences written as plain FASTQ and read again in parts of 1 MB, one task each."""
    path = shared_path(spark, "fastq")
    _fastq(spark, sf_dir).write.text(path)
    return _digested(fastx.read_parts(spark, path, split=1 << 20))


@query(_BACK)
def bz2_roundtrip(spark, sf_dir):
    path = shared_path(spark, "fastq-bz2")
    _fastq(spark, sf_dir).write.option("compression", "bzip2").text(path)
    return _digested(fastx.read_fastx(spark, path))


@query(_BACK)
def lz4_roundtrip(spark, sf_dir):
    """FASTA in LZ4 frames, one line a sequence."""
    path = shared_path(spark, "fasta-lz4")
    s = _sequences(spark, sf_dir).where("seq IS NOT NULL")
    rawmini.write_lines(s.select(F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.col("seq")).alias("value")), path, "fasta", "lz4")
    return _digested(fastx.read_fastx(spark, path))


@query(f"WITH {sql.SEQ}, r AS (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS color, seq FROM seq WHERE seq IS NOT NULL AND lang IS NOT NULL) SELECT color::INT AS color, count(*) AS n_records, sum(length(seq))::BIGINT AS n_bases FROM r GROUP BY 1")
def directory_scan(spark, sf_dir):
    """A folder with a file for each language; a file's color is its place in the listing."""
    path = shared_path(spark, "scan")
    s = _table(spark, sf_dir, "documents").select("doc_id", "lang", dna.pseudo_dna(F.col("text")).alias("seq")).where("seq IS NOT NULL AND lang IS NOT NULL")
    dim = colors.color_dimension(s, "lang")
    lines = s.join(colors.small(dim), s.lang == dim.file).select(F.concat(F.lit(">"), F.col("doc_id"), F.lit("\n"), F.col("seq")).alias("value"), "color_id")
    rawmini.write_lines(lines.repartitionById(max(1, dim.count()), F.col("color_id")), path, "fasta", "lz4")
    files = spark.createDataFrame(list(enumerate(fastx.list_files(spark, path))), "color int, file string")
    back = fastx.read_fastx(spark, [r["file"] for r in files.collect()]).join(colors.small(files), "file")
    return back.groupBy("color").agg(F.count("*").alias("n_records"), F.sum(F.length("seq")).cast("long").alias("n_bases"))


@query(f"WITH {sql.kmer_digits(6)} SELECT translate(c, '0123', 'ACTG') AS kmer, count(*) AS abundance FROM kmer GROUP BY c")
def kmer_text_roundtrip(spark, sf_dir):
    path = shared_path(spark, "kmer-text")
    counts = extract.counted_kmers(_sequences(spark, sf_dir), [], 6)
    counts.select(dna.decode(F.col("kmer"), 6), "n").write.csv(path, sep="\t")
    return fastx.read_kmer_text(spark, path)


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, {sql.WORDS_HEX} AS words FROM cs")
def raw_roundtrip(spark, sf_dir):
    """All rows written as LZ4 frames of flat words and read again."""
    rows, n = _nonzero(spark, sf_dir)
    path = shared_path(spark, "raw")
    rawmini.write_raw_nonzero(order.sort_dense(rows), path, n, "lz4")
    return rawmini.read_raw(spark, path, n, nonzero=True).select("minimizer", b.nonzero_hex(F.col("nonzero"), b.words_needed(n)).alias("words"))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT minimizer, {sql.joined()} AS colors FROM cs")
def sparse_roundtrip(spark, sf_dir):
    n = _n(spark, sf_dir)
    layout = b.SparseLayout(n)
    lists = colors.color_lists(_pairs(spark, sf_dir))
    path = shared_path(spark, "sparse")
    rawmini.write_raw(order.sort_sparse(lists).select("minimizer", b.sparse_pack(F.col("colors"), layout).alias("packed")), path, "packed", "gz")
    return rawmini.read_sparse(spark, path, n).select("minimizer", _listed(F.col("colors")).alias("colors"))


@query(f"WITH {sql.colored(_FULL, _N)} SELECT color, count(*) AS n, min(minimizer) AS first_one, max(minimizer) AS last_one FROM cs_pairs GROUP BY 1")
def by_color_roundtrip(spark, sf_dir):
    """A folder for each color, and its set read again."""
    rows, n = _nonzero(spark, sf_dir)
    path = shared_path(spark, "by-color")
    rawmini.write_by_color(colors.as_pairs(rows, n), path)
    back = spark.read.schema("minimizer long, color int").parquet(path)
    return back.groupBy("color").agg(F.count("*").alias("n"), F.min("minimizer").alias("first_one"), F.max("minimizer").alias("last_one"))


@query("""WITH v AS (SELECT unnest(range(256)) AS v), p AS (SELECT v, unnest(range(8)) AS i FROM v), m AS (SELECT v AS color, v::HUGEINT * (256::HUGEINT ** i)::HUGEINT AS x FROM p UNION SELECT v, 0 FROM v),
    k AS (SELECT x, count(DISTINCT color)::INT AS n_colors FROM m GROUP BY x) SELECT n_colors, count(*) AS occurrences FROM k GROUP BY 1""")
def generated_merge(spark, sf_dir):
    """The 256 generated sets merged: how many window hashes have how many colors."""
    rows = colors.color_words(generated_sets(spark, 256), 256)
    return stats.color_histogram(rows).select("n_colors", "occurrences")


@query(f"WITH {sql.SEQ}, p AS (SELECT DISTINCT substr(seq, unnest(range(1, length(seq) - 10)), 12) AS kmer FROM seq WHERE length(seq) >= 12) SELECT kmer, kmer AS back FROM p")
def kmer_hash_roundtrip(spark, sf_dir):
    p = extract.pieces(_sequences(spark, sf_dir), [], 12).select(F.col("mer").alias("kmer")).distinct()
    return hashing.hash_to_kmer(hashing.kmer_to_hash(p, "kmer", "h", 12), "h", "back", 12).select("kmer", "back")

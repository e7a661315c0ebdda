"""Index and retrieval: BM25 over postings, cosine, rank fusion, weighting, context."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.session import materialize, spread

K1, B, RRF = 1.2, 0.75, 60
#: Weight of a kind of chunk in a ranking; fixed values.
WEIGHTS = {"abstract": 1.5, "figure": 1.3, "prose": 1.0, "table": 1.0, "frontmatter": 0.7, "references": 0.5}

# Accented letters and their plain ones; fixed values.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def _fold(lowered: Column) -> Column:
    """Without accents; texts of plain letters pass untouched."""
    return F.when(lowered.rlike(f"[{_ACCENTED}]"), F.translate(lowered, _ACCENTED, _PLAIN)).otherwise(lowered)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without accents."""
    folded = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _once(df: DataFrame, keep: list[str], exprs: list[Column]) -> DataFrame:
    """df with costly expressions that are computed once a row: as a generator's output they are neither
    repeated in each later use nor in filters pushed down."""
    return df.select(*keep, F.inline(F.array(F.struct(*exprs))))


def postings(chunks: DataFrame, columns: tuple[str, ...] = ("text", "source", "section")) -> DataFrame:
    """``id``, ``term``, ``field``, ``pos`` of every token of the searched columns."""
    parts = None
    for i, c in enumerate(columns):
        one = chunks.select("id", F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("pos", "term"), F.lit(i).alias("field"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def bm25(chunks: DataFrame, phrases: list[list[str]], columns: tuple[str, ...] = ("text", "source", "section")) -> DataFrame:
    """``id``, ``score`` of the rows in which every phrase occurs.

    Scores are sums over phrases of idf * f (k1 + 1) / (f + k1 (1 - b + b dl / avgdl)), f counted over all
    columns. One pass makes the statistics of a row; nothing is exploded, and only one row of corpus
    statistics is joined back. For many queries over one corpus see build_postings.
    """
    phrases = [p for p in phrases if p]
    if not phrases:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    # tokens with a blank on each side, so that a phrase is a run of characters
    laid = [F.concat(F.lit(" "), F.regexp_replace(_fold(F.lower(F.coalesce(F.col(c), F.lit("")))), r"[^\p{L}\p{N}]+", "  "), F.lit(" ")).alias(f"t{i}") for i, c in enumerate(columns)]
    x = _once(spread(chunks.select("id", *columns)), ["id"], laid)
    texts = [F.col(f"t{i}") for i in range(len(columns))]
    length = sum((F.regexp_count(t, F.lit("[^ ]+")) for t in texts), F.lit(0))

    def count(phrase: list[str]) -> Column:
        """Occurrences, overlapping ones too: positions before which the phrase stands."""
        run = " " + "  ".join(phrase) + " "
        if len(set(phrase)) == len(phrase):  # cannot overlap itself
            return sum((F.floor((F.length(t) - F.length(F.replace(t, F.lit(run), F.lit("")))) / len(run)) for t in texts), F.lit(0))
        return sum((F.regexp_count(t, F.lit(f"(?={run})")) for t in texts), F.lit(0))

    x = _once(x, ["id"], [length.alias("dl"), *[count(p).alias(f"f{j}") for j, p in enumerate(phrases)]])
    stats = x.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(F.col(f"f{j}") > 0, 1)).alias(f"n{j}") for j in range(len(phrases))])
    hits = x
    for j in range(len(phrases)):
        hits = hits.where(F.col(f"f{j}") > 0)
    hits = hits.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for j in range(len(phrases)):
        idf = F.ln((F.col("n") - F.col(f"n{j}") + 0.5) / (F.col(f"n{j}") + 0.5))
        f = F.col(f"f{j}").cast("double")
        score = score + F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select("id", score.alias("score"))


#: Parts of an index by a hash of the source, and folders of its postings by a hash of the term.
SOURCE_BUCKETS, TERM_BUCKETS = 64, 64


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def term_bucket(term: str, buckets: int) -> int:
    """The bucket of a term, as _bucket gives it, without a job."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def posting_rows(chunks: DataFrame, columns: tuple[str, ...] = ("text", "source", "section"), buckets: int = TERM_BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """An inverted index: ``bucket``, ``term``, ``id``, ``field``, ``positions`` and ``dl``, the length of the row, so
    that a search needs no other table; also columns of the row to keep."""
    size = sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0))
    sized = chunks.select("id", size.alias("dl"), *keep, *columns)
    parts = [sized.select("id", "dl", *keep, F.posexplode(tokens(F.coalesce(F.col(c), F.lit("")))).alias("pos", "term"), F.lit(i).alias("field")) for i, c in enumerate(columns)]
    every = functools.reduce(DataFrame.unionByName, parts)
    p = every.groupBy("term", "id", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"), *[F.first(c).alias(c) for c in ("dl", *keep)])
    return p.withColumn("bucket", _bucket(F.col("term"), buckets))


def row_sizes(chunks: DataFrame, columns: tuple[str, ...] = ("text", "source", "section")) -> DataFrame:
    """``n``, ``tokens``: what BM25 needs to know of all rows together; sums of parts of an index add up."""
    size = sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0))
    return chunks.select(size.alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def build_postings(chunks: DataFrame, path: str, buckets: int = TERM_BUCKETS, columns: tuple[str, ...] = ("text", "source", "section")) -> None:
    """Write posting_rows in folders by bucket, and a row of sizes. A search then reads the buckets of its terms only."""
    # rows of one bucket go to a few tasks by id, so that a frequent term fills no task alone
    rows = posting_rows(chunks, columns, buckets).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "term", "id").write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    row_sizes(chunks, columns).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/stats")


def bm25_postings(spark: SparkSession, path: str, phrases: list[list[str]]) -> DataFrame:
    """What bm25 gives, from a written index. Reads one row of sizes at once; the rest is one plan."""
    stats = spark.read.parquet(f"{path}/stats").first()
    return score_postings(spark.read.parquet(f"{path}/postings"), phrases, stats["n"], stats["tokens"], stats["buckets"])


def score_postings(table: DataFrame, phrases: list[list[str]], n: int, total: int, buckets: int) -> DataFrame:
    """``id``, ``score`` of the rows in which every phrase occurs.

    Partitions are pruned to the buckets of the terms, and term filters reach the scan; each posting carries
    the length of its row, so nothing else is joined but the number of rows that hold a phrase.
    """
    phrases = [p for p in phrases if p]
    if not phrases:
        return table.select("id", F.lit(0.0).alias("score")).limit(0)
    hits, average = None, total / max(1, n)
    for j, phrase in enumerate(phrases):
        x = None
        for d, word in enumerate(phrase):
            one = table.where((F.col("bucket") == term_bucket(word, buckets)) & (F.col("term") == word)).select("id", "field", F.col("positions").alias(f"p{d}"), *(["dl"] if d == 0 else []))
            x = one if x is None else x.join(one, ["id", "field"])
        starts = F.col("p0")
        for d in range(1, len(phrase)):
            starts = F.array_intersect(starts, _shift(F.col(f"p{d}"), d))
        f = x.select("id", "dl", F.size(starts).alias("f")).where("f > 0").groupBy("id").agg(F.sum("f").cast("double").alias("f"), F.first("dl").alias("dl"))
        idf = F.ln((n - F.col("holding") + 0.5) / (F.col("holding") + 0.5))
        part = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / average))
        f = f.join(F.broadcast(f.agg(F.count("*").alias("holding")))).select("id", part.alias(f"s{j}"))  # one row
        hits = f if hits is None else hits.join(f, "id")
    return hits.select("id", sum((F.col(f"s{j}") for j in range(len(phrases))), F.lit(0.0)).alias("score"))


def _shift(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda e: e - by)


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k rows of highest score; ties by id."""
    return scored.orderBy(F.col(by).desc(), "id").limit(k)


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a literal query vector, null where lengths differ; sums in double."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.transform(v, lambda e: e.cast("double"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, e: s + e)

    dot = total(F.zip_with(d, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(d, lambda e: e * e)))
    qn = float(sum(float(x) ** 2 for x in query)) ** 0.5
    return F.when(F.size(v) == len(query), dot / (norm * qn + 1e-8))


def semantic(chunks: DataFrame, query: list[float], vector_col: str = "embedding") -> DataFrame:
    """``id``, ``score``: cosine of every row with the query. Rows without a finite score are left out.

    Only id and vector are read; texts are fetched for the winners alone.
    """
    s = chunks.select("id", cosine(F.col(vector_col), query).alias("score"))
    return s.where(F.col("score").isNotNull() & ~F.isnan("score"))


def ranked(scored: DataFrame, k: int, method: str, list_no: int) -> DataFrame:
    """The top k with their ``rank`` (from 1)."""
    return top(scored, k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), "id"))).select("id", "score", "rank", F.lit(method).alias("method"), F.lit(list_no).alias("list_no"))


def fuse(lists: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (list_no, rank, id, method): ``id``, ``rrf_score``, ``method``.

    Ties keep the order of the lists.
    """
    m = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "method"))), lambda s: s["method"]), "+")
    return lists.groupBy("id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf_score"), m.alias("method"), F.min(F.struct("list_no", "rank")).alias("first"))


def weight(kind: Column) -> Column:
    w = F.lit(1.0)
    for name, value in WEIGHTS.items():
        w = F.when(kind == name, value).otherwise(w)
    return w


def hybrid(chunks: DataFrame, phrases: list[list[str]], query: list[float], k: int = 10) -> DataFrame:
    """Text and vector search, each cut to its best 2k, fused, weighted by kind, cut to k."""
    return fused(chunks, bm25(chunks, phrases), semantic(chunks, query), k)


def fused(chunks: DataFrame, text: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The same of scores (id, score) from any text and vector search over chunks."""
    both = fuse(ranked(text, 2 * k, "text", 0).unionByName(ranked(vectors, 2 * k, "semantic", 1))).join(chunks.select("id", "content_type"), "id")
    both = both.withColumn("weighted_score", F.col("rrf_score") * weight(F.col("content_type")))
    return both.orderBy(F.col("weighted_score").desc(), F.col("rrf_score").desc(), "first", "id").limit(k).select("id", "method", "rrf_score", "weighted_score")


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (id, source, chunk_index) with the texts before and after; of chunks indexed twice the last counts."""
    last = chunks.groupBy("source", "chunk_index").agg(F.max_by("text", "id").alias("text"))
    b = last.select("source", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("text").alias("context_before"))
    a = last.select("source", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("text").alias("context_after"))
    x = hits.join(b, ["source", "chunk_index"], "left").join(a, ["source", "chunk_index"], "left")
    return x.fillna("", ["context_before", "context_after"])


def section_context(hits: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """``id``, ``section_context``: the nearest chunks of the same parent, joined by blank lines.

    The nearest have one of the `most` indexes on either side, or the hit's own, so one window over the indexes
    of each parent finds them; no hit meets all chunks of its parent. hits must be rows of chunks.
    """
    c = chunks.where("coalesce(parent_id, '') <> ''").select("id", "source", "parent_id", "chunk_index", "text")
    c = c.join(hits.select("source", "parent_id").distinct(), ["source", "parent_id"], "left_semi")
    # chunks indexed again share an index; those of the smallest ids come first
    by_index = c.groupBy("source", "parent_id", "chunk_index").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "chunk_index", "text"))), 1, most + 1).alias("here"))
    w = Window.partitionBy("source", "parent_id").orderBy("chunk_index").rowsBetween(-most, most)
    near = by_index.select("source", "parent_id", "chunk_index", F.flatten(F.collect_list("here").over(w)).alias("near"))
    x = hits.select("id", "source", "parent_id", "chunk_index").join(near, ["source", "parent_id", "chunk_index"])
    others = F.transform(F.filter("near", lambda s: s["id"] != F.col("id")), lambda s: F.struct(F.abs(s["chunk_index"] - F.col("chunk_index")).alias("d"), s["chunk_index"].alias("i"), s["id"].alias("n"), s["text"].alias("t")))
    found = x.select("id", F.array_join(F.transform(F.slice(F.array_sort(others), 1, most), lambda s: s["t"]), "\n\n").alias("section_context"))
    return hits.select("id").join(found, "id", "left").fillna("", ["section_context"])


def figure_context(hits: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """``id``, ``figure_context``: the first figures of the same parent, the hit itself not left out."""
    h = hits.where("coalesce(parent_id, '') <> ''").select("id", "source", "parent_id")
    c = chunks.where("content_type = 'figure'").select(F.col("id").alias("other"), "source", "parent_id", "chunk_index", "text")
    w = Window.partitionBy("id").orderBy("chunk_index", "other")
    x = h.join(c, ["source", "parent_id"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    found = x.groupBy("id").agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n\n").alias("figure_context"))
    return hits.select("id").join(found, "id", "left").fillna("", ["figure_context"])


def result_columns(chunks: DataFrame) -> DataFrame:
    """Columns of a result, each falling back on the metadata where it is null or empty."""
    def fall(col: str, path: str) -> Column:
        return F.coalesce(F.when(F.col(col) != "", F.col(col)), F.get_json_object("metadata", path), F.lit(""))

    return chunks.select("id", fall("chunk_id", "$.chunk_id").alias("chunk_id"), fall("parent_id", "$.parent_id").alias("parent_id"), fall("section_path", "$.section_path").alias("section_path"), fall("content_type", "$.content_type").alias("content_type"), F.coalesce(F.get_json_object("metadata", "$.doc_year"), F.lit("")).alias("doc_year"))


def list_indexes(chunks: DataFrame) -> DataFrame:
    """Chunks by source, and a total (``is_total``); a null source is a source like others."""
    return chunks.rollup("source").agg(F.count("*").alias("chunk_count"), (F.grouping("source") == 1).alias("is_total")).select("source", "is_total", "chunk_count")


def replace_by_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """Delete-then-insert: rows of old whose source new does not hold, and all of new."""
    return old.join(new.select("source").distinct(), "source", "left_anti").unionByName(new, allowMissingColumns=True)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", vector: str = "embedding") -> DataFrame:
    """chunks with the vectors an embedder gives for their texts, asked batch by batch; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed(texts.fillna("").tolist())], dtype=object)

    return chunks.withColumn(vector, run(F.col(text)))


class Index:
    """A chunk index in a folder.

    Every ingest writes a version: the chunks of all parts (hashes of sources) that it touches, and the postings
    text search reads, in folders by a hash of the term. A manifest names the version in which each part counts;
    it is written last, so a write that fails half way leaves the manifest before it in force.
    """

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        if self.path.endswith(".db"):  # the path is the index itself, whatever its name
            self.where = self.path
        else:
            self.where = f"{self.path}/index_name={name}"

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def exists(self) -> bool:
        return self._version() >= 0

    def _version(self) -> int:
        """The number of the last manifest that was written whole; -1 without one."""
        done = [int(x.split("=")[1]) for x in self._names(f"{self.where}/manifest") if x.startswith("version=")]
        return max((v for v in done if "_SUCCESS" in self._names(f"{self.where}/manifest/version={v}")), default=-1)

    def _manifest(self) -> list:
        """(bucket, version, n, tokens) of every folder that counts; at most SOURCE_BUCKETS rows."""
        version = self._version()
        if version < 0:
            raise FileNotFoundError(f"no index {self.name!r} in {self.path}")
        return self.spark.read.parquet(f"{self.where}/manifest/version={version}").collect()

    def _read(self, kind: str, rows: list) -> DataFrame:
        """The rows of the parts that count, version by version; filters on the part reach the scan."""
        parts: dict[int, list[int]] = {}
        for r in rows:
            parts.setdefault(r["version"], []).append(r["bucket"])
        paths = [f"{self.where}/{kind}/version={v}" for v in sorted(parts)]
        x = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.where}/{kind}").parquet(*paths)
        alive = functools.reduce(Column.__or__, [(F.col("version") == v) & F.col("source_bucket").isin(b) for v, b in sorted(parts.items())])
        return x.where(alive).drop("version", "source_bucket")

    def chunks(self) -> DataFrame:
        return self._read("chunks", self._manifest())

    def ingest(self, new: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> int:
        """Replace the sources that new holds; only parts with these sources are read and written. With an embedder
        the vectors are made here. Returns the rows of new; an empty new changes nothing."""
        if embed is not None:
            new = embedded(new, embed)
        part = _bucket(F.coalesce("source", F.lit("")), SOURCE_BUCKETS)
        new = materialize(new.withColumn("source_bucket", part), "ingest")
        touched = {r[0] for r in new.select("source_bucket").distinct().collect()}
        if not touched:
            return 0
        old = self._manifest() if self.exists() else []
        mine = [r for r in old if r["bucket"] in touched]
        version = self._version() + 1
        while f"version={version}" in self._names(f"{self.where}/chunks"):  # left behind by a write that failed
            version += 1
        every = new
        if mine:
            gone = new.select(F.col("source").alias("__s")).distinct()
            kept = self._read("chunks", mine).join(gone, F.col("source").eqNullSafe(F.col("__s")), "left_anti")
            every = kept.withColumn("source_bucket", part).unionByName(new, allowMissingColumns=True)
        at = f"{self.where}/{{}}/version={version}"
        every.sortWithinPartitions("source_bucket").write.mode("errorifexists").parquet(at.format("chunks"))
        written = self.spark.read.parquet(at.format("chunks"))
        texts = ("text", "source", "section")
        searched = written.select("id", "source_bucket", *[F.col(c) if c in written.columns else F.lit(None).cast("string").alias(c) for c in texts])
        # rows of one term bucket go to a few tasks by id, so that a frequent term fills no task alone
        rows = posting_rows(searched, texts, TERM_BUCKETS, ("source_bucket",)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4)))
        rows.sortWithinPartitions("bucket", "term", "id").write.mode("errorifexists").partitionBy("bucket").parquet(at.format("postings"))
        size = sum((F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in texts), F.lit(0))
        counted = searched.select("source_bucket", size.alias("dl")).groupBy("source_bucket").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()
        rows = [(r["bucket"], r["version"], r["n"], r["tokens"]) for r in old if r["bucket"] not in touched] + [(r["source_bucket"], version, r["n"], r["tokens"]) for r in counted]
        self.spark.createDataFrame(rows, "bucket int, version int, n long, tokens long").coalesce(1).write.mode("errorifexists").parquet(f"{self.where}/manifest/version={version}")
        return new.count()

    def text_search(self, phrases: list[list[str]]) -> DataFrame:
        """``id``, ``score`` by BM25, from the postings of the query's terms alone."""
        rows = self._manifest()
        return score_postings(self._read("postings", rows), phrases, sum(r["n"] for r in rows), sum(r["tokens"] for r in rows), TERM_BUCKETS)

    def search(self, query: str, vector: list[float] | None = None, mode: str = "hybrid", k: int = 10, context: bool = False, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
        """The k best chunks for a query, with all their columns but the vector; with context also the texts
        around them, of their section and of its figures. An embedder makes the query's vector if none is given."""
        phrases, c = phrases_of(query), self.chunks()
        if vector is None:
            vector = [float(x) for x in embed([query])[0]] if embed is not None and mode != "text" else []
        if mode == "text":
            found = top(self.text_search(phrases), k)
        elif mode == "semantic":
            found = top(semantic(c, vector), k)
        else:
            found = fused(c, self.text_search(phrases), semantic(c, vector), k)
        found = found.join(c.drop("embedding"), "id")
        if not context:
            return found
        around = neighbours(found, c)
        return around.join(section_context(found, c), "id").join(figure_context(found, c), "id")


def indexes(spark: SparkSession, path: str) -> DataFrame:
    """``index_name``, ``source``, ``is_total``, ``chunk_count`` of all indexes in a folder; none gives no row."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
    found = [Index(spark, path, n.split("=", 1)[1]) for n in names if n.startswith("index_name=")]
    parts = [list_indexes(x.chunks()).select(F.lit(x.name).alias("index_name"), "source", "is_total", "chunk_count") for x in found if x.exists()]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "index_name string, source string, is_total boolean, chunk_count long")


def phrases_of(query: str) -> list[list[str]]:
    """The phrases of a query: each of its terms, cut as texts are cut; terms of marks only count for nothing."""
    import re
    import unicodedata

    out = []
    for term in query.split():
        plain = "".join(c for c in unicodedata.normalize("NFKD", term.lower()) if not unicodedata.combining(c))
        out.append([t for t in re.split(r"[\W_]+", plain) if t])
    return [p for p in out if p]

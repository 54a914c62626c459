"""A stored token table: written once, refreshed for changed documents, read by what a criterion asks for.

``postings`` holds (id, w, t, p, c) in folders by batch and shard, a shard being a hash of the word, and is
bucketed by the document and sorted by word: a search reads the shards of its words and gathers a document's
positions without a shuffle, and a frequent word lies in as many files as there are buckets.  ``vocabulary``
has the words of each shard and ``grams`` their runs of three characters, so that a wildcard reads the
shards of matching words only.  ``numbers`` has the numbers of fields in folders by field and number of
digits, sorted by value, for comparisons.  ``index`` holds (id, batch, indexed, n_tokens) and is written
last: a batch that isn't in it doesn't exist, and a refresh that died is written over by the next one.

A document's latest batch counts; earlier ones are taken out by an anti join on what was superseded, which
is as small as what changed, until ``compact`` writes all that is current into one batch.  Without a date
column a document that was indexed once counts as unchanged.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crivo.functions.tokens import postings, with_tokens
from crivo.operators.criteria import Criterion, compile_criterion
from crivo.plans.arrays import matches, spellings, wild_pattern
from crivo.plans.postings import comparisons, fits_nothing, needed
from crivo.plans.syntax import Blank, Compare, Node, Term, words_of

SHARDS = 16
GRAM = 3
#: Fixed values of the ranking: how fast a word's weight is full, and how much length counts.
K1, B = 1.2, 0.75


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; in local mode, where that may be unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-crivo-")
    return f"{base.rstrip('/')}/crivo/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Needs:
    """What a criterion reads: words by name, words by pattern, numbers by field; ``every`` if all shards."""

    words: tuple[str, ...]
    wild: tuple[Term, ...]
    numbers: tuple[Compare, ...]
    every: bool

    @staticmethod
    def of(node: Node, synonyms: Mapping[str, Sequence[str]]) -> Needs:
        terms, compared = words_of(node), comparisons(node)
        by_number = tuple(c for c in compared if c.sign != "=" and c.value.isdigit())
        exact = {w for t in terms if not t.wild for w in spellings(t, synonyms)} | {c.value for c in compared if c.sign == "="}
        wild = tuple(t for t in terms if t.wild and t.word.strip("$?"))
        return Needs(tuple(sorted(exact)), wild, by_number, any(c.sign != "=" and not c.value.isdigit() for c in compared))


def digits(number: Column) -> Column:
    return F.length(number.cast("string"))


@dataclass(frozen=True)
class TokenStore:
    """Where the tokens of a corpus lie; ids are unique in it, rows with a null id aren't indexed.

    ``buckets`` is the number of parts that documents are dealt into, by default that of the partitions in
    which the first batch is read; it is settled by the first refresh.
    """

    path: str
    id_col: str = "doc_id"
    document: str = "text"
    date_col: str | None = None
    shards: int = SHARDS
    buckets: int | None = None

    # --- what there is ---

    def part(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def index(self, spark: SparkSession) -> DataFrame | None:
        """(id, batch, indexed, n_tokens) of all finished batches; None before the first one."""
        try:
            return spark.read.parquet(f"{self.path}/index")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def latest(self, spark: SparkSession) -> DataFrame:
        last = F.max_by(F.struct("batch", "indexed", "n_tokens"), "batch").alias("z")
        return self.index(spark).groupBy(self.id_col).agg(last).select(self.id_col, "z.*")

    def live(self, spark: SparkSession) -> list[int]:
        """Batches that hold a document's latest tokens: as many as refreshes since the last compaction."""
        if self.index(spark) is None:
            raise ValueError(f"{self.path}: not indexed yet")
        return [r[0] for r in self.latest(spark).select("batch").distinct().collect()]

    def outdated(self, docs: DataFrame) -> DataFrame:
        """Documents that were never indexed, or changed since (all indexed ones are fresh without a date)."""
        if self.index(docs.sparkSession) is None:
            return docs
        known = self.latest(docs.sparkSession).select(F.col(self.id_col).alias("_id"), "indexed")
        fresh = F.col(self.id_col) == F.col("_id")
        if self.date_col:
            fresh &= F.col(self.date_col).isNull() | (F.col(self.date_col) <= F.col("indexed"))
        return docs.join(known, fresh, "left_anti")

    def id_kind(self, spark: SparkSession) -> str:
        return self.index(spark).schema[self.id_col].dataType.simpleString()

    def dealt(self, spark: SparkSession, parts: int | None = None) -> int:
        """The number of buckets: as settled, else as asked for, else ``parts``, else as of a shuffle."""
        try:
            return spark.read.parquet(f"{self.path}/layout").first()["buckets"]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        buckets = self.buckets or parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{self.path}/layout")
        return buckets

    @property
    def name(self) -> str:
        return f"postings_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}"

    def table(self, spark: SparkSession, kind: str) -> str:
        """The name of the bucketed table over ``postings``, known to this session from now on."""
        name = self.name
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (`{self.id_col}` {kind}, w STRING, t INT, p INT, c STRING, batch INT, shard INT) USING parquet PARTITIONED BY (batch, shard) CLUSTERED BY (`{self.id_col}`) SORTED BY (w) INTO {self.dealt(spark)} BUCKETS LOCATION '{self.path}/postings'")
        spark.catalog.refreshTable(name)
        return name

    # --- writing ---

    @contextmanager
    def alone(self, spark: SparkSession):
        """Keep other writers out; a lock that a dead writer left behind is for its owner to delete."""
        lock = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lock")
        files = lock.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(lock.getParent())
        if not files.createNewFile(lock):
            raise RuntimeError(f"{self.path}/lock: another refresh is running, or one has died")
        try:
            yield
        finally:
            files.delete(lock, False)

    def shard(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.shards)).cast("int")

    def refresh(self, docs: DataFrame) -> int:
        """Tokenise what is outdated into a new batch; the batch's number."""
        spark = docs.sparkSession
        with self.alone(spark):
            batch = self.next_batch(spark)
            stamp = F.col(self.date_col).cast("timestamp") if self.date_col else F.lit(None).cast("timestamp")
            changed = f"{self.path}/changed/batch={batch}"
            wanted = docs.where(F.col(self.id_col).isNotNull())
            # The documents are settled once, so that postings and index speak of the same ones.
            self.outdated(wanted).select(self.id_col, self.document, stamp.alias("indexed")).write.mode("overwrite").parquet(changed)
            scan = spark.read.parquet(changed)
            # As many buckets as the first batch's scan has partitions, which follow its bytes.
            self.dealt(spark, max(1, scan.rdd.getNumPartitions()))
            self.write(postings(with_tokens(scan, self.document), self.id_col), batch)
            epoch = F.lit("1970-01-01").cast("timestamp")
            # Sizes are counted in what was written, so that texts aren't tokenised once more.
            sizes = self.written(spark, batch).groupBy(self.id_col).agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))
            self.finish(scan.join(sizes, self.id_col, "left").select(self.id_col, F.coalesce("indexed", epoch).alias("indexed"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), batch)
            folder = spark._jvm.org.apache.hadoop.fs.Path(changed)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return batch

    def next_batch(self, spark: SparkSession) -> int:
        index = self.index(spark)
        return 1 if index is None else (index.agg(F.max("batch")).first()[0] or 0) + 1

    def write(self, rows: DataFrame, batch: int) -> None:
        """Postings of a batch and what is derived from them; what a died refresh left of it goes."""
        spark, kind = rows.sparkSession, rows.schema[self.id_col].dataType.simpleString()
        for name in ("postings", "vocabulary", "grams", "numbers"):
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        name = self.table(spark, kind)
        numbered = rows.withColumn("batch", F.lit(batch)).withColumn("shard", self.shard(F.col("w")))
        # Dealt like the buckets: a task writes one file for each shard of its bucket.
        numbered.repartition(self.dealt(spark), self.id_col).sortWithinPartitions("shard", "w", self.id_col).select(*spark.table(name).columns).write.insertInto(name)
        spark.catalog.refreshTable(name)
        written = self.written(spark, batch)
        words = written.groupBy("w", "shard").agg(F.count(F.lit(1)).alias("n"))
        words.repartition("shard").sortWithinPartitions("w").write.partitionBy("shard").parquet(f"{self.path}/vocabulary/batch={batch}")
        starts = F.sequence(F.lit(1), F.length("w") - (GRAM - 1))
        listed = self.part(spark, f"vocabulary/batch={batch}", "w string, n long, shard int").where(F.length("w") >= GRAM)
        grams = listed.select(F.explode(F.array_distinct(F.transform(starts, lambda k: F.substring("w", k, F.lit(GRAM))))).alias("gram"), "w", "shard").withColumn("slot", self.shard(F.col("gram")))
        grams.repartition("slot").sortWithinPartitions("gram").write.partitionBy("slot").parquet(f"{self.path}/grams/batch={batch}")
        number = F.col("w").cast("decimal(38,0)")
        numbers = written.where((F.col("c") != "") & F.col("w").rlike("^[0-9]{1,38}$")).select(self.id_col, number.alias("number"), "c", digits(number).alias("digits")).distinct()
        numbers.repartitionByRange("c", "digits", "number").sortWithinPartitions("c", "digits", "number").write.partitionBy("c", "digits").parquet(f"{self.path}/numbers/batch={batch}")

    def written(self, spark: SparkSession, batch: int) -> DataFrame:
        """The postings of a batch whose writing has ended, whether or not the index knows it yet."""
        return spark.table(self.name).where(F.col("batch") == batch)

    def finish(self, documents: DataFrame, batch: int) -> None:
        documents.select(self.id_col, F.lit(batch).alias("batch"), "indexed", "n_tokens").write.mode("append").parquet(f"{self.path}/index")

    def compact(self, ids: DataFrame | None = None) -> int:
        """Write all current postings, of the documents in ``ids`` if given, as one batch; older ones are read no more."""
        spark = (ids or self.index(SparkSession.getActiveSession())).sparkSession
        with self.alone(spark):
            batch, current = self.next_batch(spark), self.latest(spark)
            rows = self.postings(spark)
            if ids is not None:
                kept = ids.select(self.id_col).distinct()
                current, rows = current.join(kept, self.id_col, "left_semi"), rows.join(kept, self.id_col, "left_semi")
            self.write(rows, batch)
            self.finish(current, batch)
        return batch

    # --- reading ---

    def superseded(self, spark: SparkSession, live: list[int]) -> DataFrame | None:
        """(id, batch) of tokens in live batches that a later batch has replaced; None if there can't be any."""
        if len(live) < 2:
            return None
        last = Window.partitionBy(self.id_col)
        return self.index(spark).withColumn("_last", F.max("batch").over(last)).where("batch < _last").where(F.col("batch").isin(*live)).select(self.id_col, "batch")

    def current(self, rows: DataFrame, live: list[int]) -> DataFrame:
        old = self.superseded(rows.sparkSession, live)
        rows = rows.where(F.col("batch").isin(*live))
        return rows if old is None else rows.join(old, [self.id_col, "batch"], "left_anti")

    def postings(self, spark: SparkSession, words: Sequence[str] | None = None, shards: Sequence[int] | None = None) -> DataFrame:
        """Current postings, of the given words or shards or all."""
        live = self.live(spark)
        rows = spark.table(self.table(spark, self.id_kind(spark)))
        if words is not None:
            shards = self.shards_of(spark, words)
            rows = rows.where(F.col("w").isin(*words))
        if shards is not None:
            rows = rows.where(F.col("shard").isin(*shards))
        return self.current(rows, live).select(self.id_col, "w", "t", "p", "c")

    def shards_of(self, spark: SparkSession, words: Sequence[str]) -> list[int]:
        if not words:
            return []
        return [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(self.shard(F.col("w"))).distinct().collect()]

    def wild_words(self, spark: SparkSession, term: Term) -> DataFrame:
        """(w, shard) of the vocabulary's words that a wildcard matches, found by a run of three characters if it has one."""
        live = self.live(spark)
        longest = max(re.split(r"[$?]", term.word), key=len)
        if len(longest) >= GRAM:
            gram = longest[:GRAM]
            slots = self.shards_of(spark, [gram])
            rows = self.part(spark, "grams", "gram string, w string, shard int, batch int, slot int").where(F.col("slot").isin(*slots) & (F.col("gram") == gram))
        else:
            rows = self.part(spark, "vocabulary", "w string, n long, batch int, shard int")
        return rows.where(F.col("batch").isin(*live) & F.col("w").rlike(wild_pattern(term.word))).select("w", "shard").distinct()

    def numbers(self, spark: SparkSession, n: Compare) -> DataFrame:
        """(id, w, t, p, c) of the numbers of a field that compare as asked, from the folders that can hold them."""
        rows = self.part(spark, "numbers", f"`{self.id_col}` {self.id_kind(spark)}, number decimal(38,0), batch int, c string, digits int")
        value = F.lit(n.value).cast("decimal(38,0)")
        size = len(str(int(n.value)))
        near = {">": F.col("digits") >= size, ">=": F.col("digits") >= size, "<": F.col("digits") <= size, "<=": F.col("digits") <= size}.get(n.sign, F.lit(True))
        fits = {">": F.col("number") > value, ">=": F.col("number") >= value, "<": F.col("number") < value, "<=": F.col("number") <= value, "<>": F.col("number") != value}[n.sign]
        rows = self.current(rows.where((F.col("c") == n.field) & near & fits), self.live(spark))
        return rows.select(self.id_col, F.col("number").cast("string").alias("w"), F.lit(0).alias("t"), F.lit(0).alias("p"), "c")

    def needed(self, spark: SparkSession, c: Criterion) -> DataFrame:
        """The postings that a criterion can need."""
        needs = Needs.of(c.node, c.synonyms or {})
        shards: set[int] | None = None
        if not needs.every:
            shards = set(self.shards_of(spark, needs.words))
            for term in needs.wild:
                # As many rows as there are shards reach the driver.
                shards |= {r[0] for r in self.wild_words(spark, term).select("shard").distinct().collect()}
        rows = self.postings(spark, shards=None if shards is None else sorted(shards)).where(needed(c.node, c.synonyms or {}))
        for n in needs.numbers:
            rows = rows.unionByName(self.numbers(spark, n))
        return rows

    def search(self, ids: DataFrame, criterion: Criterion | str) -> DataFrame:
        """The ids of the matching documents among ``ids``, the corpus as it is now."""
        c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
        spark, wanted = ids.sparkSession, ids.select(self.id_col).where(F.col(self.id_col).isNotNull()).distinct()
        if c.node is None:
            return wanted.limit(0)
        if isinstance(c.node, Blank):
            return wanted.join(self.latest(spark).where("n_tokens = 0").select(self.id_col), self.id_col, "left_semi")
        held = self.gathered(spark, c)
        passes = matches(c.node, F.col("tok"), c.synonyms)
        if fits_nothing(c.node):
            return wanted.join(held.where(~passes).select(self.id_col), self.id_col, "left_anti")
        return held.where(passes).select(self.id_col).join(wanted, self.id_col, "left_semi")

    def gathered(self, spark: SparkSession, c: Criterion) -> DataFrame:
        """(id, tok): the positions that a criterion needs, one row a document that has any."""
        return self.needed(spark, c).groupBy(self.id_col).agg(F.collect_list(F.struct("w", "t", "p", "c")).alias("tok"))

    def ranked(self, ids: DataFrame, criterion: Criterion | str, limit: int = 1000) -> DataFrame:
        """(id, score) of the best matches: the sum over the criterion's words of their weight in the document.

        A word's weight is ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)),
        with N documents, df of them with the word, tf its frequency; ties by id.  The numbers are those of
        the corpus as it is now; one of them for each word reaches the driver.
        """
        c = compile_criterion(criterion) if isinstance(criterion, str) else criterion
        spark = ids.sparkSession
        names = sorted({t.word for t in words_of(c.node) if not t.wild}) if c.node is not None else []
        corpus = self.latest(spark).join(ids.select(self.id_col).distinct(), self.id_col, "left_semi")
        size = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
        found = self.search(ids, c)
        tf = self.postings(spark, names).groupBy(self.id_col, "w").agg(F.count(F.lit(1)).alias("tf"))
        tf = tf.join(corpus.select(self.id_col, "n_tokens"), self.id_col)
        df = {r["w"]: r["n"] for r in tf.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()} if names else {}
        rarity = F.lit(0.0)
        for w in names:
            held = df.get(w, 0)
            rarity = F.when(F.col("w") == w, F.log(F.lit(1 + (size["n"] - held + 0.5) / (held + 0.5)))).otherwise(rarity)
        weight = rarity * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.lit(float(size["mean"] or 1))))
        score = tf.withColumn("weight", weight).groupBy(self.id_col).agg(F.sum("weight").alias("score"))
        return found.join(score, self.id_col, "left").select(self.id_col, F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), self.id_col).limit(limit)



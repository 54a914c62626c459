"""Tables that searches keep: their columns, and their creation in a catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Columns of each table.
SCHEMAS = {
    "document_config": "doc_type string, created timestamp, table_name string, text_col string, score_col string, id_col string, seq_col string, date_col string, replace_text boolean",
    "session": "session string, doc_type string, created timestamp, status string, status_ts timestamp, n_prefiltered int, n_removed int, n_accepted int",
    "session_doc": "session string, id string, seq int, score float, created timestamp, status string, status_ts timestamp",
    "token_map": "doc_type string, id string, seq int, map string, map_len int, text_len int, created timestamp, used timestamp",
    "processed_text": "doc_type string, id string, seq int, text string, map_len int, text_len int, created timestamp",
    "comparison_cache": "doc_type string, id string, seq int, status string, criterion_sha1 string, created timestamp, used timestamp",
    "documents": "seq bigint, domain string, id string, seq_document int, text string, is_json boolean, text_len int, score float, created timestamp",
    "scratch_text": "seq bigint, text string, created timestamp",
    "words": "word string, is_word boolean, is_singular boolean, df int, origin string, created timestamp",
}
#: Tables that grow with every search are parted by what is looked up or dropped as a whole.
PARTITIONS = {"session_doc": "session", "token_map": "doc_type", "processed_text": "doc_type", "comparison_cache": "doc_type", "documents": "domain"}


def create_tables(spark: SparkSession, database: str, using: str = "parquet") -> list[str]:
    """Create the database and the tables that it lacks; the tables' names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in SCHEMAS.items():
        parted = f" PARTITIONED BY (`{PARTITIONS[name]}`)" if name in PARTITIONS else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING {using}{parted}")
    return [f"{database}.{name}" for name in SCHEMAS]

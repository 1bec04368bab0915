"""Tables kept as versions of Parquet with a pointer, and Markdown documents: the engine's sinks and state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lodestone.functions.text import escape_cell
from lodestone.operators import relational as R


class Store:
    """Named tables under a folder (a URI that all executors share).

    A write makes a new version beside the old one and then moves a small pointer file over the old pointer, so a
    reader sees one whole version or the other (K1, K4, K9), and an upsert can read what it replaces (M1).
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.base = pafs.FileSystem.from_uri(self.root)

    def _pointer(self, name: str) -> str:
        return f"{self.base}/{name}/current.json"

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self._pointer(name)).type != pafs.FileType.NotFound

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; a table that was never written is empty if a schema is given."""
        if not self.exists(name):
            if schema is None:
                raise FileNotFoundError(name)
            kind = _parse_datatype_string(schema)
            return self.spark.createDataFrame(to_arrow_schema(kind).empty_table(), kind)  # of Arrow, as the planner sees that it is empty
        with self.fs.open_input_stream(self._pointer(name)) as f:
            said = json.loads(f.read())
        # the schema is kept too, as an empty table written by partition has no file to tell it
        return self.spark.read.schema(StructType.fromJson(said["schema"])).parquet(f"{self.root}/{name}/{said['version']}")

    def write(self, name: str, df: DataFrame, partition: Sequence[str] = (), keep: int = 2) -> None:
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(*partition) if partition else df.write
        writer.parquet(f"{self.root}/{name}/{version}")
        past = []
        if self.exists(name):
            with self.fs.open_input_stream(self._pointer(name)) as f:
                said = json.loads(f.read())
            past = [said["version"], *said["past"]]
        draft = f"{self._pointer(name)}.{version}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"version": version, "past": past[: keep - 1], "schema": df.schema.jsonValue()}).encode())
        self.fs.move(draft, self._pointer(name))
        for old in past[keep - 1 :]:
            if self.fs.get_file_info(f"{self.base}/{name}/{old}").type != pafs.FileType.NotFound:
                self.fs.delete_dir(f"{self.base}/{name}/{old}")

    def write_if_changed(self, name: str, df: DataFrame) -> bool:
        """Writes only what differs from the current version as a bag of rows (K7); says whether it did."""
        if self.exists(name):
            now = self.read(name)
            if now.columns == df.columns and now.exceptAll(df).isEmpty() and df.exceptAll(now).isEmpty():
                return False
        self.write(name, df)
        return True

    def upsert(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> int:
        """Rows in place of those with their key (M1, M3); returns how many keys were there before."""
        old = self.read(name, new._jdf.schema().toDDL())
        updated = new.select(*keys).distinct().join(old, list(keys), "left_semi").count()
        self.write(name, R.upsert(old, new, keys, order))
        return updated

    def delete(self, name: str, gone: Column) -> None:
        """Drops the rows for which gone is true (M2)."""
        self.write(name, self.read(name).where(~F.coalesce(gone, F.lit(False))))

    def append_unique(self, name: str, new: DataFrame, keys: Sequence[str]) -> int:
        """Adds the rows whose keys are new (M3); returns their number."""
        old = self.read(name, new._jdf.schema().toDDL())
        fresh = R.first_wins(new.join(old, list(keys), "left_anti"), keys, [F.lit(0)])
        n = fresh.count()
        if n:
            self.write(name, old.unionByName(fresh))
        return n


def markdown_table(df: DataFrame, group: Sequence[str], columns: dict[str, str], order: Sequence[str], title: Column) -> DataFrame:
    """One Markdown document per group: a heading and a table of its rows in order (K2, K3, K5)."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(escape_cell(F.col(c).cast("string")), F.lit("")) for c in columns)), F.lit(" |"))
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, cells.alias("_line")))).alias("_rows"))
    head = "| " + " | ".join(columns.values()) + " |\n|" + "---|" * len(columns)
    body = F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n")
    return rows.select(*group, F.concat(F.lit("# "), title, F.lit(f"\n\n{head}\n"), body, F.lit("\n")).alias("markdown"))


def markdown_sections(cards: DataFrame, group: Sequence[str], title: Column) -> DataFrame:
    """One document per group with a section per card (K8, K10): rows are kept and rendered anew, never patched."""
    text = F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("name")), F.nullif(F.trim("description"), F.lit("")), F.when(F.size("exports") > 0, F.concat(F.lit("exports: "), F.array_join("exports", ", "))), F.concat(F.lit("source: "), "source_path"))
    rows = cards.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("name", "id", text.alias("_text")))).alias("_rows"))
    return rows.select(*group, F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform("_rows", lambda r: r["_text"]), "\n\n"), F.lit("\n")).alias("markdown"))


def write_documents(docs: DataFrame, folder: str, name: Callable[[dict], str]) -> int:
    """Writes (…, markdown) rows as files named by name(row), each by the task that holds the row."""

    def run(batches):
        import pyarrow as pa

        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{name(row)}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(row["markdown"].encode())
                fs.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return docs.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

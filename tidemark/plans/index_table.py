"""The index as plain Parquet: documents appended per commit, plus a small table of commits.

A run appends its changes and never rewrites what is there, so its cost follows the size of
the change and not the size of the index. Every row carries the commit that wrote it and whether it puts
or removes its ``doc_id``; reading takes one row per id: that of the newest commit, in it the one of the highest
``_seq`` (an order the caller may give), then a put before a removal, then the last in the written
files. The first commit is a full copy where its ids are unique. After ``fold_after`` commits the changes are folded into a new full copy;
``compact`` does so at any time. A commit counts once its row is in the commit
table, which is written last, so a job that dies half-way leaves the index as it was: its rows
have an id that no commit names.

Text moves as little as it can. Reading finds the rows that later commits void by ids and places and hands their places to the scans
as masks, one bit per row. A commit of few indexes is written by the tasks that made its rows.

One writer at a time per table, as with scheduled runs that must not overlap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.changes import index_counts, likely_rows, list_documents, list_indexes
from ..schema import DOCUMENT
from ..session import cut, run_folder

#: Up to so many indexes in a commit, every task writes its own rows; with more, rows are gathered by index first, lest files be many and small.
FEW_INDEXES = 16

_STORED = T.StructType(
    [*[f for f in DOCUMENT.fields if f.name != "index_name"]]
    + [
        T.StructField("removed", T.BooleanType()),
        T.StructField("_seq", T.LongType()),
        T.StructField("commit_no", T.LongType()),
        T.StructField("commit_id", T.StringType()),
        T.StructField("index_name", T.StringType()),
    ]
)
_COMMITS = T.StructType(
    [
        T.StructField("commit_no", T.LongType()),
        T.StructField("commit_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("index_name", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
_COLUMNS = [f.name for f in DOCUMENT.fields]
_ID = ["index_name", "doc_id"]
# 64 rows of a file share a mask
_VOIDS = T.StructType(
    [
        T.StructField("_file", T.StringType()),
        T.StructField("_block", T.LongType()),
        T.StructField("_mask", T.LongType()),
        T.StructField("index_name", T.StringType()),
    ]
)
_COUNTS = "index_name string, owner string, delta bigint, commit_no bigint"


def _seq_of(df: DataFrame) -> Column:
    return (F.col("_seq") if "_seq" in df.columns else F.lit(None)).cast("long").alias("_seq")


def _named() -> Column:
    """A row without its index or id is no change of any document."""
    return F.col("index_name").isNotNull() & F.col("doc_id").isNotNull()


class IndexTable:
    def __init__(self, spark: SparkSession, root: str, fold_after: int = 64, keep_counts: bool = False):
        """With ``keep_counts`` every commit lands signed counts per index and owner, which ``counts`` sums; use it from the first commit on."""
        self.spark = spark
        self.fold_after = fold_after
        self.keep_counts = keep_counts
        self.root = root.rstrip("/")
        self._kept_voids: tuple[str | None, str | None, frozenset[str], DataFrame] | None = None
        # an empty commit table, unless there is one already
        self._row(0, "", "none", {}).limit(0).write.mode("ignore").parquet(f"{self.root}/commits")

    # ---- commits ----

    def commits(self) -> DataFrame:
        """All finished commits; a few rows per run."""
        return self.spark.read.schema(_COMMITS).parquet(f"{self.root}/commits")

    def _live(self) -> tuple[str | None, list[str], DataFrame | None]:
        """The newest full copy, the changes after it, and what was dropped after it.

        The list of changes has one id per run since the last full copy, ``fold_after`` at most. Drops stay a frame,
        ``(index_name, owner, dropped_at)``; without an owner the whole index went.
        """
        done = self.commits()
        newest_full = done.where("kind = 'full'").agg(F.coalesce(F.max("commit_no"), F.lit(0)))
        since = done.where(F.col("commit_no") >= newest_full.scalar())
        drops = since.where("kind IN ('drop', 'replace')")
        # one row stands for all drops: there may be many, and they are joined, not collected
        rows = since.where("kind IN ('full', 'change')").unionByName(drops.limit(1)).collect()
        base = [r.commit_id for r in rows if r.kind == "full"]
        changes = [r.commit_id for r in rows if r.kind == "change"]
        dropped = drops.groupBy("index_name", "owner").agg(F.max("commit_no").alias("dropped_at"))
        any_drop = any(r.kind in ("drop", "replace") for r in rows)
        return (base[0] if base else None), changes, (dropped if any_drop else None)

    def _row(self, number: int, commit_id: str, kind: str, about: dict) -> DataFrame:
        values = {"commit_no": number, "commit_id": commit_id, "kind": kind, **about}
        return self.spark.range(1, numPartitions=1).select(
            *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in _COMMITS.fields]
        )

    def _named(self, names: DataFrame, number: int, commit_id: str, kind: str) -> DataFrame:
        """Commit rows for a frame of ``(index_name, owner)``."""
        values = {"commit_no": number, "commit_id": commit_id, "kind": kind}
        return names.select("index_name", "owner").distinct().select(
            *[
                F.col(f.name) if f.name in names.columns else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name)
                for f in _COMMITS.fields
            ]
        )

    def _commit(self, kind: str, number: int, commit_id: str, **about) -> None:
        self._row(number, commit_id, kind, about).write.mode("append").parquet(f"{self.root}/commits")

    def _next(self) -> int:
        newest = self.commits().agg(F.max("commit_no")).first()[0]
        return (newest or 0) + 1

    # ---- reading ----

    def _rows(self, commit_ids: list[str], dropped: DataFrame | None) -> DataFrame:
        """The rows of some commits; only their folders are listed."""
        home = f"{self.root}/documents"
        paths = [f"{home}/commit_id={c}" for c in commit_ids]
        rows = self.spark.read.schema(_STORED).option("basePath", home).parquet(*paths)
        rows = rows.select(
            "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
        return self._without(rows, dropped)

    @staticmethod
    def _without(rows: DataFrame, dropped: DataFrame | None) -> DataFrame:
        """The rows but for those that a later drop or replacement voids."""
        if dropped is None:
            return rows
        whole = dropped.where(F.col("owner").isNull()).select("index_name", "dropped_at")
        owned = dropped.where(F.col("owner").isNotNull())
        for gone, keys in ((whole, ["index_name"]), (owned, ["index_name", "owner"])):
            gone = gone.select(*[F.col(k).alias(f"_{k}") for k in keys], "dropped_at")
            hit = F.col("commit_no") < F.col("dropped_at")
            for k in keys:
                hit = hit & (F.col(k) == F.col(f"_{k}"))
            rows = rows.join(gone, hit, "left_anti")
        return rows

    def read(self) -> DataFrame:
        """All documents as of the last commit.

        With no changes since the last full copy this is a plain scan. Otherwise rows that do not count are left out by
        their places: a table of masks, a bit per row, which is broadcast while it is small; no text is shuffled.
        """
        base, changes, dropped = self._live()
        if base is None and not changes:
            return self.spark.createDataFrame([], DOCUMENT)
        full = self._rows([base], dropped) if base else None
        if not changes:
            return full.select(*_COLUMNS)
        changed = self._rows(changes, dropped).where(_named())
        voids = self._voids(base, changes, dropped)
        puts = self._unvoided(changed.where(~F.col("removed")), voids)
        return puts if full is None else self._unvoided(full, voids).unionByName(puts)

    def _voids(self, base: str | None, changes: list[str], dropped: DataFrame | None) -> DataFrame:
        """``(index_name, _file, _block, _mask)``: which rows later ones take the place of. Reads ids and places, no text.

        Every index with changes has a row, so its folder is there for a filter on the index. The masks are kept for the next read:
        it uses them again, or adds what the commits since then void. Drops make rows count again that a dropped one had
        taken the place of, so after them nothing is kept.
        """
        kept = self._kept_voids
        if dropped is not None or kept is None or kept[:2] != (run_folder(), base) or not kept[2] <= set(changes):
            kept = None
        if kept and len(kept[2]) == len(changes):
            return kept[3]
        known = kept[2] if kept else frozenset()
        # the newer commits come after all that are known: what they name takes the place of any earlier row
        changed = self._rows([c for c in changes if c not in known], dropped).where(_named())
        place = F.struct("commit_no", "_seq", (~F.col("removed")).alias("put"), "_file", "_row")
        ranked = changed.select(*_ID, "_file", "_row", "removed", place.alias("_place"))
        ranked = ranked.withColumn("_last", F.col("_place") == F.max("_place").over(Window.partitionBy(*_ID)))
        marked = ranked.select("index_name", "_file", "_row", (~F.col("_last")).alias("_void"))
        earlier = [*([base] if base else []), *known]
        if earlier:
            older = likely_rows(self._rows(earlier, dropped).select(*_ID, "_file", "_row"), changed, _ID)
            beaten = older.join(ranked.where("_last").select(*_ID), _ID, "left_semi")
            marked = marked.unionByName(beaten.select("index_name", "_file", "_row", F.lit(True).alias("_void")))
        bit = F.when(F.col("_void"), F.expr("shiftleft(1L, CAST(_row & 63 AS INT))")).otherwise(F.lit(0).cast("long"))
        bits = marked.select("index_name", "_file", F.shiftright("_row", 6).alias("_block"), bit.alias("_mask"))
        if kept:
            bits = bits.unionByName(kept[3])
        masks = bits.groupBy("index_name", "_file", "_block").agg(F.bit_or("_mask").alias("_mask"))
        voids = cut(masks.select(*[f.name for f in _VOIDS.fields]), "voids", "index_name")
        self._kept_voids = None if dropped is not None else (run_folder(), base, frozenset(changes), voids)
        return voids

    @staticmethod
    def _unvoided(rows: DataFrame, voids: DataFrame) -> DataFrame:
        masks = voids.withColumnsRenamed({c: f"_v{c}" for c in voids.columns})
        same = (F.col("index_name") == F.col("_vindex_name")) & (F.col("_file") == F.col("_v_file"))
        same = same & (F.shiftright("_row", 6) == F.col("_v_block"))
        void = F.expr("_v_mask & shiftleft(1L, CAST(_row & 63 AS INT))") != 0
        return rows.join(masks, same & void, "left_anti").select(*_COLUMNS)

    # ---- counts ----

    def counts(self) -> DataFrame:
        """``(index_name, owner, n_documents)`` from what the commits landed, without a look at the documents.

        A full copy lands its counts whole, a change what it added and took away; drops and replacements void what was landed before them.
        """
        if not self.keep_counts:
            raise ValueError("this table was opened without keep_counts")
        base, changes, dropped = self._live()
        ids = [base, *changes] if base else changes
        if not ids:
            rows = self.spark.createDataFrame([], _COUNTS)
        else:
            rows = self.spark.read.schema(_COUNTS).parquet(*[f"{self.root}/counts/commit_id={c}" for c in ids])
        rows = self._without(rows, dropped)
        summed = rows.groupBy("index_name", "owner").agg(F.sum("delta").alias("n_documents"))
        return summed.where("n_documents <> 0")

    def miscounts(self) -> DataFrame:
        """Where the landed counts and a count of all documents differ: ``(index_name, owner, landed, counted)``; empty as long as all is well."""
        counted = index_counts(self.read()).withColumnRenamed("n_documents", "counted")
        landed = self.counts().withColumnRenamed("n_documents", "landed")
        same = [counted[c].eqNullSafe(landed[c]) for c in ("index_name", "owner")]
        both = counted.join(landed, same[0] & same[1], "full_outer").where(~F.col("counted").eqNullSafe(F.col("landed")))
        return both.select(F.coalesce(counted["index_name"], landed["index_name"]).alias("index_name"), F.coalesce(counted["owner"], landed["owner"]).alias("owner"), "landed", "counted")

    def _land_counts(self, commit_id: str, number: int, deltas: DataFrame) -> None:
        rows = deltas.select("index_name", "owner", F.col("delta").cast("long").alias("delta"), F.lit(number).cast("long").alias("commit_no"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/commit_id={commit_id}")

    def _deltas(self, commit_id: str, replaces: DataFrame | None) -> DataFrame:
        """What a commit that is written, but not yet in the table of commits, adds and takes away. Reads ids and owners, no text.

        The rows of a replaced owner go by the replacement itself, so they are not taken away once more.
        """
        rows = self._rows([commit_id], None)
        place = F.struct("_seq", (~F.col("removed")).alias("put"), "_file", "_row")
        last = rows.groupBy(*_ID).agg(F.max_by(F.struct("owner", "removed"), place).alias("last"))
        came = last.where(~F.col("last.removed")).select("index_name", "last.owner").groupBy("index_name", "owner").agg(F.count("*").alias("delta"))
        before = self.read().select(*_ID, "owner").join(last.select(*_ID), _ID, "left_semi")
        if replaces is not None:
            names = replaces.select("index_name", "owner").distinct()
            before = before.join(names, ["index_name", "owner"], "left_anti")
        went = before.groupBy("index_name", "owner").agg((-F.count("*")).alias("delta"))
        return came.unionByName(went)

    def list_indexes(self) -> DataFrame:
        """The names of all indexes that hold a document.

        Names are folders of the written files. Those that no change since the last full copy touches need no search for the newest
        rows; of the others, whose documents may all be gone, only their own folders are read.
        """
        base, changes, dropped = self._live()
        if base is None or not changes:
            return list_indexes(self.read())
        touched = self._rows(changes, None).select("index_name").distinct()
        calm = self._rows([base], dropped).select("index_name").distinct().join(touched, "index_name", "left_anti")
        return calm.unionByName(list_indexes(self.read().join(touched, "index_name", "left_semi")))

    def list_documents(self, index_name: str, metadata_filter=None, limit: int = 10, offset: int = 0, after=None):
        """One page of documents; see ``operators.changes.list_documents``."""
        return list_documents(self.read(), index_name, metadata_filter, limit, offset, after)

    # ---- writing ----

    def _write(self, documents: DataFrame, number: int, n_indexes: int | None = None) -> str:
        """Write rows under a new commit id.

        Rows of few indexes are written where they are, a file per task and index, and no text is shuffled; rows of many are
        gathered by index into even files.
        """
        commit_id = uuid.uuid4().hex
        if n_indexes is None:
            n_indexes = self._n_indexes(documents)
        rows = documents.withColumn("commit_no", F.lit(number).cast("long"))
        if n_indexes > FEW_INDEXES:
            rows = rows.hint("rebalance", "index_name")
        rows.write.partitionBy("index_name").parquet(f"{self.root}/documents/commit_id={commit_id}")
        return commit_id

    def _n_indexes(self, documents: DataFrame) -> int:
        """Of how many indexes a commit is where the caller does not know: as many as the table has folders for; for a first commit the names are counted, without the text."""
        base, changes, _ = self._live()
        live = [base, *changes] if base else changes
        files = self._rows(live, None).inputFiles() if live else []
        names = {f.rsplit("/index_name=", 1)[1].split("/")[0] for f in files if "/index_name=" in f}
        return len(names) or documents.select("index_name").distinct().limit(FEW_INDEXES + 1).count()

    def _is_full(self, commit_id: str) -> bool:
        """Whether a first commit can stand as a full copy: no id in it twice. Reads ids only."""
        ids = self._rows([commit_id], None).groupBy(*_ID).agg(F.count("*").alias("n"))
        return ids.where("n > 1").isEmpty()

    def _stored(self, documents: DataFrame) -> DataFrame:
        return documents.select(*_COLUMNS, F.lit(False).alias("removed"), _seq_of(documents))

    def _removals(self, ids: DataFrame) -> DataFrame:
        empty = [
            F.lit(None).cast(f.dataType).alias(f.name)
            for f in DOCUMENT.fields
            if f.name not in ("doc_id", "index_name")
        ]
        gone = ids.select("doc_id", "index_name", *empty, F.lit(True).alias("removed"), _seq_of(ids))
        return gone.select(*_COLUMNS, "removed", "_seq")

    def apply(
        self,
        upserts: DataFrame | None = None,
        deletes: DataFrame | None = None,
        writer: str | None = None,
        batch_id: int | None = None,
        replaces: DataFrame | None = None,
        n_indexes: int | None = None,
    ) -> bool:
        """Append one commit of puts and removals; both name their index and ``doc_id``.

        With a writer and a batch id, a batch that was committed before is skipped. ``replaces``
        lists ``(index_name, owner)`` whose earlier documents this commit takes the place of. A long column
        ``_seq`` in either frame orders the rows of one id; without it an id both put and removed is put.
        ``n_indexes``, how many indexes the documents are of, spares a look where the caller knows it.
        """
        if writer is not None and batch_id is not None:
            seen = (F.col("writer") == writer) & (F.col("batch_id") >= batch_id)
            if not self.commits().where(seen).isEmpty():
                return False
        parts = []
        if upserts is not None:
            parts.append(self._stored(upserts))
        if deletes is not None:
            parts.append(self._removals(deletes))
        if not parts:
            return False
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        number = self._next()
        commit_id = self._write(rows, number, n_indexes)
        first = self.commits().where("kind IN ('full', 'change')").isEmpty()
        kind = "full" if first and deletes is None and self._is_full(commit_id) else "change"
        if self.keep_counts:
            # before the commit counts: a job that dies here leaves counts that no commit names
            self._land_counts(commit_id, number, self._deltas(commit_id, replaces if kind == "change" else None))
        row = self._row(number, commit_id, kind, {"writer": writer, "batch_id": batch_id})
        if replaces is not None and kind == "change":
            row = row.unionByName(self._named(replaces, number, commit_id, "replace"))
        # one file, so that a commit and what it replaces appear together
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        if kind == "change" and len(self._live()[1]) >= self.fold_after:
            self.compact()
        return True

    def index_documents(self, documents: DataFrame) -> None:
        self.apply(upserts=documents)

    update_documents = index_documents

    def delete_documents(self, ids: DataFrame) -> None:
        self.apply(deletes=ids)

    def drop(self, index_name: str) -> None:
        """Drop an index; dropping one that is not there changes nothing."""
        self._commit("drop", self._next(), uuid.uuid4().hex, index_name=index_name)

    def drop_all(self, names: DataFrame) -> None:
        """Drop every index that a frame names, in one commit."""
        gone = names.select("index_name", F.lit(None).cast("string").alias("owner"))
        rows = self._named(gone, self._next(), uuid.uuid4().hex, "drop")
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def compact(self) -> None:
        """Write the current state as a new full copy."""
        number = self._next()
        commit_id = self._write(self._stored(self.read()), number)
        if self.keep_counts:
            self._land_counts(commit_id, number, self.counts().withColumnRenamed("n_documents", "delta"))
        self._commit("full", number, commit_id)

    def obsolete_commits(self) -> DataFrame:
        """Commits that reading no longer touches; their folders may be deleted by whoever keeps
        house, once no job reads an older state."""
        done = self.commits()
        newest_full = done.where("kind = 'full'").agg(F.coalesce(F.max("commit_no"), F.lit(0)))
        older = F.col("commit_no") < newest_full.scalar()
        return done.where(older & F.col("kind").isin("full", "change")).select("commit_no", "commit_id")

    # ---- copies ----

    def persist(self, index_name: str, path: str) -> None:
        self.read().where(F.col("index_name") == index_name).write.parquet(path)

    def load(self, index_name: str, path: str, overwrite: bool = True) -> None:
        """Bring a persisted index back; without ``overwrite`` only unknown ids are added."""
        saved = self.spark.read.schema(DOCUMENT).parquet(path).withColumn("index_name", F.lit(index_name))
        present = self.read().where(F.col("index_name") == index_name)
        if overwrite:
            # one commit: the old documents go when the new ones come
            self.apply(upserts=saved, replaces=present.select("index_name", "owner").distinct(), n_indexes=1)
        else:
            self.apply(upserts=saved.join(present.select("doc_id"), "doc_id", "left_anti"), n_indexes=1)

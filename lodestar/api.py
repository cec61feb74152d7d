"""One object for a project: its index, history, memory and vectors, and every query over them."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import stopnames
from .functions.text import expand, groups_of, new_terms, with_concepts
from .model import BUDGETS, RATIONALE_AUTO, SCHEMAS, IndexConfig, Weights, resolve_budget, top_k
from .operators import change, graph, history, memory, reports, search, vectors
from .plans import ask, explore, index
from .sources import records, trees

MOST_SEEDS = 200


class Project:
    """A source tree below root with an index in the folder `store`; tables are read lazily and kept for the session."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: IndexConfig | None = None, vectors_path: str | None = None, stop: DataFrame | None = None):
        self.spark, self.root, self.store, self.config, self.vectors_path = spark, root, store, config or IndexConfig(), vectors_path
        self.stop = stopnames.stop_table(spark) if stop is None else stop
        self._index: index.Index | None = None

    # index

    def index(self, full: bool = False) -> Project:
        """Build the index, or bring it up to date where there is one of this schema."""
        old = None if full else self.known()
        made = index.full(self.spark, self.root, self.config, self.stop) if old is None else index.incremental(self.spark, old, self.root, self.config, self.stop)
        return self.written(made)

    def index_paths(self, paths: list[str]) -> Project:
        """Read these files again and no others; without an index, a full one is built."""
        if not paths:
            raise ValueError("no paths given")
        old = self.known()
        return self.index(full=True) if old is None else self.written(index.targeted(self.spark, old, self.root, paths, self.config, self.stop))

    def index_changed(self) -> Project:
        """Read again what git says has changed."""
        old = self.known()
        return self.index(full=True) if old is None else self.written(index.changed(self.spark, old, self.root, self.config, self.stop))

    def known(self) -> index.Index | None:
        try:
            return index.load(self.spark, f"{self.store}/index")
        except (FileNotFoundError, ValueError):
            return None

    def written(self, made: index.Index) -> Project:
        self._index = made.write(f"{self.store}/index")
        return self

    @property
    def tables(self) -> index.Index:
        if self._index is None:
            self._index = index.load(self.spark, f"{self.store}/index")
        return self._index

    @property
    def symbols(self) -> DataFrame:
        return search.with_search_columns(self.tables.symbols)

    def files(self) -> DataFrame:
        """The files table with the project's annotations laid over it."""
        path = Path(self.store, "annotations")
        files = self.tables.files
        return reports.apply_annotations(files, records.annotations(self.spark, str(path))) if path.exists() else files

    def lines(self) -> DataFrame:
        """(path, line, text) of the files that were read."""
        rows = trees.read_tree(self.spark, self.root, self.config).filter("state = 'full'")
        return rows.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")

    def k(self, budget: str) -> int:
        return top_k(resolve_budget(budget, self.tables.files.count()) if budget == "auto" else budget)

    # search

    def find_symbol(self, text: str, budget: str = "small") -> DataFrame:
        return search.find_symbol(self.symbols, text, self.k(budget))

    def get_symbol(self, name: str) -> DataFrame:
        return search.get_symbol(self.symbols, name)

    def find_files(self, text: str, budget: str = "small", scope: str | None = None) -> DataFrame:
        return search.find_files(self.files(), self.symbols, text, self.k(budget), scope)

    def find_related(self, path: str, budget: str = "small") -> DataFrame:
        return search.find_related(self.files(), self.symbols, self.tables.relations, path, self.k(budget))

    def semantic_search(self, text: str, budget: str = "small", query: list[float] | None = None) -> DataFrame:
        """By vectors where a query vector and a store are given (test code at 0.7), else by words and their variants."""
        if query is None or not self.vectors_path:
            return search.semantic_keyword(self.symbols, text, self.k(budget))
        hits = vectors.top_k(self.vectors(), query, 2 * self.k(budget)).join(self.symbols, "id")
        score = F.col("cosine") * F.when(C.is_test_path(F.col("path")), 0.7).otherwise(1.0)
        return hits.withColumn("score", score).orderBy(F.desc("score"), "ordinal").limit(self.k(budget))

    def grep(self, words: list[str], files: int = 20) -> DataFrame:
        """The first hit of each file, with the smallest symbol around it."""
        hits = search.grep(self.lines(), words, files)
        spans = self.symbols.select("path", "id", "name", F.col("span.start_line").alias("start"), F.col("span.end_line").alias("end"))
        return hits.join(change.innermost(spans, hits.select("path", "line")).select("path", "line", "name"), ["path", "line"], "left")

    def ask(self, text: str, budget: str = "small", weights: Weights | None = None, query: list[float] | None = None) -> DataFrame:
        hits = None
        if query is not None and self.vectors_path:
            hits = vectors.top_k(self.vectors(), query, 2 * self.k(budget)).join(self.symbols.select("id", "path"), "id")
        return ask.ask(self.symbols, self.files(), self.tables.relations, text, budget, weights, hits)

    def ask_context(self, text: str, budget: str = "small", include: tuple[str, ...] = ("code",), **options: object) -> dict[str, DataFrame]:
        """The packet and the layers asked for beside it: code (first lines of each item), rationale, history (of its files)."""
        packet = self.ask(text, budget, **options)
        out = {"packet": packet}
        if "code" in include:
            spans = self.symbols.select("path", "name", F.col("span.start_line").alias("a"), F.least(F.col("span.end_line"), F.col("span.start_line") + max(BUDGETS[budget][1], 1) - 1).alias("b"))
            picked = F.broadcast(packet.select("rank", "path", "name").join(spans, ["path", "name"]))  # as many rows as the budget has
            body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
            out["code"] = self.lines().join(picked, "path").filter(F.col("line").between(F.col("a"), F.col("b"))).groupBy("rank", "path", "name").agg(body.alias("code")).orderBy("rank")
        if "rationale" in include:
            out["rationale"] = self.rationale(text, budget)
        if "history" in include:
            commits, files = self.log(history.WINDOW)
            rows = files.join(F.broadcast(packet.select("path").distinct()), "path", "left_semi").join(commits, "hash")
            place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), "hash"))
            out["history"] = rows.withColumn("place", place).filter(F.col("place") <= BUDGETS[budget][4]).drop("place")
        return out

    def synonyms(self, most: int = 5000) -> tuple[tuple[str, ...], ...]:
        """Groups of interchangeable words for expand(), with the short forms among the commonest words of the project's names."""
        words = self.symbols.select(F.explode("name_words").alias("w")).filter(F.length("w") >= 2).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(most)
        return groups_of([r["w"] for r in words.collect()])

    def new_terms(self, text: str) -> list[str]:
        """What a concept search adds to the words of a question."""
        return new_terms(expand(text).words)

    def concept_search(self, text: str, budget: str = "small") -> DataFrame:
        return search.semantic_keyword(self.symbols, " ".join(with_concepts(expand(text).words)), self.k(budget))

    def investigate(self, text: str, budget: str = "small") -> DataFrame:
        return explore.investigate(self.symbols, self.files(), self.tables.relations, records.changed_paths(self.spark, self.root), text, budget)

    def debug_trace(self, trace: str, budget: str = "small") -> DataFrame:
        return explore.debug_trace(self.spark.createDataFrame([("trace", trace)], "id string, text string"), self.symbols, self.files(), budget)

    # looking around

    def status(self) -> DataFrame:
        return reports.status(self.files(), self.symbols)

    def outline(self, budget: str = "small") -> DataFrame:
        return reports.outline(self.files(), self.k(budget))

    def onboard(self) -> DataFrame:
        return explore.onboard(self.files(), self.symbols, graph.dependency_edges(self.tables.relations))

    def file_outline(self, path: str) -> DataFrame:
        return explore.file_outline(self.symbols, path)

    def explore_symbol(self, name: str, budget: str = "small") -> DataFrame:
        return explore.explore_symbol(self.symbols, name, budget)

    def edit_context(self, name: str) -> DataFrame:
        return ask.edit_context(self.symbols, self.tables.relations, self.lines(), self.tables.memories, name)

    def glossary(self, k: int = 30, terms: dict[str, str] | None = None) -> DataFrame:
        return reports.glossary(self.symbols, k, curated=terms)

    def hotspots(self, k: int = 20, churn: bool = False, files: bool = False) -> DataFrame:
        span = F.col("span.end_line") - F.col("span.start_line") + 1
        rows = self.files().select(C.file_name(F.col("path")).alias("name"), "path", F.col("size").alias("lines")) if files else self.symbols.select("name", "path", span.alias("lines"))
        return reports.hotspots(rows, history.commit_counts(self.log()[1]) if churn else None, k)

    # graph

    def callers(self, name: str) -> DataFrame:
        return graph.callers(self.symbols, self.tables.relations, name)

    def callees(self, name: str) -> DataFrame:
        return graph.callees(self.symbols, self.tables.relations, name)

    def why_no_callers(self, name: str) -> str:
        return self.why_no_edges(name, "callers")

    def why_no_edges(self, name: str, side: str = "callers") -> str:
        """Why a list of callers or callees is empty."""
        dropped = self.tables.dropped.select(F.col("target_id" if side == "callers" else "source_id").alias("id")).distinct()
        busy = bool(self.symbols.filter(F.col("name") == name).join(dropped, "id", "left_semi").head(1))
        return graph.no_callers_because(self.symbols, self.tables.relations, name, [name] if busy else [], tuple(stopnames.names()) if side == "callers" else ())

    def affected(self, name: str, depth: int = 3) -> DataFrame:
        """(id, name, path, depth) of what reaches a symbol of this name or its file."""
        own = self.symbols.filter(F.col("name_lower") == name.lower())
        seeds = own.select(F.explode(F.array("id", "file_id")).alias("id")).distinct().withColumn("seed", F.lit(name))
        return graph.affected(graph.dependency_edges(self.tables.relations), seeds, depth).join(self.symbols.select("id", "name", "path"), "id")

    def coupling(self, k: int = 20) -> DataFrame:
        ids = self.tables.files.select("id", "path").unionByName(self.tables.symbols.select("id", "path"))
        edges = self.tables.relations.filter((F.col("kind") != "calls") | (F.col("weight") >= graph.STRONG))
        edges = edges.join(ids.select(F.col("id").alias("source_id"), F.col("path").alias("source")), "source_id").join(ids.select(F.col("id").alias("target_id"), F.col("path").alias("target")), "target_id")
        together = history.partners(history.co_change_pairs(self.log(history.WINDOW)[1])).groupBy("path").agg(F.count(F.lit(1)).alias("partners"))
        return graph.coupling(edges.select("source", "target"), together).orderBy(F.desc("risk_score"), "path").limit(k)

    def affected_provenance(self, name: str, depth: int = 3) -> DataFrame:
        """affected() with the kind of edge that leads a step nearer."""
        own = self.symbols.filter(F.col("name_lower") == name.lower())
        seeds = own.select(F.explode(F.array("id", "file_id")).alias("id")).distinct().withColumn("seed", F.lit(name))
        return change.affected_with_reasons(self.tables.relations, seeds, depth).join(self.symbols.select("id", "name", "path"), "id")

    # changes

    def log(self, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        return records.log(self.spark, self.root, most)

    def hunks(self) -> DataFrame:
        return change.unified_diff(records.diff_lines(self.spark, self.root))

    def changed(self) -> DataFrame:
        spans = self.symbols.withColumns({"start": F.col("span.start_line"), "end": F.col("span.end_line")})
        hunks = self.hunks().select("path", F.col("start").alias("h_start"), F.col("end").alias("h_end"))
        return change.overlapping(spans, hunks).select(*self.symbols.columns).dropDuplicates(["id"])

    def diff_context(self, budget: str = "small") -> DataFrame:
        return explore.diff_context(self.hunks(), self.symbols, budget)

    def commit_context(self, commit: str, budget: str = "small") -> DataFrame:
        return explore.diff_context(change.unified_diff(records.commit_hunks(self.spark, self.root, commit)), self.symbols, budget, commit)

    def affected_by_change(self, depth: int = 3) -> DataFrame:
        """The blast radius of the working tree's diff, of MOST_SEEDS changed symbols at most."""
        seeds = self.changed().orderBy("ordinal").limit(MOST_SEEDS).select(F.lit("diff").alias("seed"), "id")
        return graph.affected(graph.dependency_edges(self.tables.relations), seeds, depth).join(self.symbols.select("id", "name", "path"), "id")

    def smart_tests(self) -> DataFrame:
        return change.smart_tests(self.changed(), self.symbols, self.tables.relations, self.tables.files)

    def untested(self) -> DataFrame:
        return change.untested(self.changed(), self.symbols, self.tables.relations, self.tables.files)

    def missing_co_changes(self) -> DataFrame:
        return history.missing_co_changes(self.log(history.WINDOW)[1], records.changed_paths(self.spark, self.root), present=self.tables.files.select("path"))

    def verify_change(self, depth: int = 3) -> DataFrame:
        return change.verify_change(self.hunks(), self.symbols, self.tables.relations, self.tables.files, self.log(history.WINDOW)[1], depth)

    def contract_changes(self) -> DataFrame:
        return change.contract_changes(self.changed(), self.hunks())

    def history(self, path: str, budget: str = "small") -> DataFrame:
        """Commits of a path, through its renames."""
        commits, files = records.log(self.spark, self.root, path=path)
        return history.file_history(commits, files.withColumn("path", F.lit(path)), path, BUDGETS[budget][4])

    def symbol_history(self, name: str, budget: str = "small") -> DataFrame:
        """Commits that touched the lines of a symbol: those of a blame of its span, newest first."""
        own = self.get_symbol(name).select("path", "span.start_line", "span.end_line").first()
        if own is None:
            return self.log(1)[0].limit(0)
        lines = records.blame(self.spark, self.root, own["path"], own["start_line"], own["end_line"])
        return self.log()[0].join(lines.select("hash").distinct(), "hash", "left_semi").orderBy(F.desc("ts"), "hash").limit(BUDGETS[budget][4])

    def change_timeline(self, path: str) -> DataFrame:
        said = self.memories().filter("kind = 'decision'").select(F.to_timestamp("updated_at").alias("ts"), F.coalesce("title", "content").alias("text"), memory.anchors(F.col("content")).alias("anchors"), F.try_element_at("related_files", F.lit(1)).alias("path"))
        return history.timeline(*self.log(), said, path)

    def blame(self, path: str, start: int, end: int) -> DataFrame:
        return history.first_of_runs(records.blame(self.spark, self.root, path, start, end), "path", "line", "hash")

    # annotations

    def annotations(self) -> DataFrame:
        path = Path(self.store, "annotations")
        return records.annotations(self.spark, str(path)) if path.exists() else self.spark.createDataFrame([], SCHEMAS["annotations"])

    def annotate(self, path: str, purpose: str, terms: dict[str, str] | None = None) -> None:
        """Say what a file is for; a file's own doc still wins over it."""
        own = self.tables.files.filter(F.col("path") == path).select("hash").first()
        if own is None:
            raise ValueError(f"not indexed: {path}")
        records.write_annotations(reports.upsert_annotation(self.annotations(), path, purpose, own["hash"], datetime.now(UTC).isoformat(timespec="seconds"), terms), f"{self.store}/annotations")

    def forget_annotation(self, path: str) -> None:
        records.write_annotations(reports.without_annotation(self.annotations(), path), f"{self.store}/annotations")

    def annotation_queue(self, k: int = 10) -> DataFrame:
        return reports.annotation_queue(self.files(), self.tables.relations, k)

    # memory

    def memories(self) -> DataFrame:
        return records.project_memory(self.spark, f"{self.store}/memory")

    def remember(self, kind: str, content: str, **fields: object) -> str:
        folder = f"{self.store}/memory"
        entry = {"id": records.next_id(folder), "kind": kind, "status": "active", "pinned": False, "tags": [], "related_files": [], "related_symbols": []} | fields | {"content": content}
        records.write_entry(folder, entry)
        return entry["id"]

    def memory_search(self, text: str, budget: str = "small", **filters: object) -> DataFrame:
        return memory.shaped(memory.search(self.memories(), text, BUDGETS[budget][3], **filters))

    def memory_conflicts(self, budget: str = "small") -> DataFrame:
        return memory.conflicts(self.memories()).orderBy("signal").limit(BUDGETS[budget][5])

    def rationale(self, text: str, budget: str = "small") -> DataFrame:
        """Comments and document sections that touch the anchors of a text."""
        own = self.spark.createDataFrame([(text,)], "t string").select(memory.anchors(F.col("t"))).first()[0]
        k = BUDGETS[budget][2] if budget in BUDGETS else RATIONALE_AUTO
        docs = trees.read_tree(self.spark, self.root, self.config).filter(F.col("path").rlike(r"^(docs?|adr|decisions)/.*\.md$|^[^/]*\.md$") & (F.col("state") == "full"))
        sections = memory.doc_sections(docs, "path", "content").withColumn("id", F.concat_ws(":", F.lit("mem"), "path", "section"))
        sections = sections.select("id", "path", "kind", F.col("body").alias("text"), memory.anchors(F.concat_ws(" ", "header", "body")).alias("anchors"), "weight")
        both = self.tables.memories.select("id", "path", "kind", "text", "anchors", F.col("weight").cast("double").alias("weight")).unionByName(sections)
        return memory.rationale(both, own, k)

    # vectors and export

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self.vectors_path)

    def to_embed(self) -> DataFrame:
        """Symbols without a vector of their present text."""
        return vectors.stale(self.vectors(), vectors.embed_text(self.symbols))[0]

    def sync_vectors(self, embedder: vectors.HashingEmbedder) -> None:
        """Embed what has no vector of its present text, drop what is gone; the new store stands beside the old one until it is whole."""
        target = f"{self.vectors_path.rstrip('/')}-{uuid.uuid4().hex}"
        known = self.vectors() if Path(self.vectors_path).exists() else self.spark.createDataFrame([], SCHEMAS["embeddings"])
        vectors.synced(known, vectors.embed_text(self.symbols), embedder).write.parquet(target)
        self.vectors_path = target

    def vector_status(self) -> DataFrame:
        return vectors.coverage(self.vectors(), vectors.embed_text(self.symbols))

    def export_jsonl(self, path: str) -> None:
        t = self.tables
        reports.jsonl(file=t.files, symbol=t.symbols, relation=t.relations, memory=t.memories).write.text(path)

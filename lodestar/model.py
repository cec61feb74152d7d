"""Schemas, domains and tunables of the engine."""

from __future__ import annotations

from dataclasses import dataclass

SPAN = "struct<start_line:int,end_line:int,start_col:int,end_col:int>"
#: Spark DDL of every logical table.
SCHEMAS = {
    "files": "id string, path string, extension string, language string, size long, hash string, indexed_at timestamp, tags array<string>, purpose string, purpose_source string",
    "symbols": f"id string, file_id string, name string, kind string, language string, path string, signature string, span {SPAN}, parent_symbol_id string, exported boolean, visibility string, doc_summary string, ordinal long",
    "relations": "source_id string, target_id string, kind string, weight float",
    "raw_imports": "path string, import_path string, names array<string>, line int",
    "raw_calls": "path string, caller_line int, callee string, is_method boolean",
    "raw_comments": "path string, text string, line int, end_line int, kind string, attached_symbol_id string",
    "memories": "id string, path string, kind string, text string, anchors array<string>, weight float, symbol_id string, line_range struct<start:int,end:int>",
    "project_memory": "id string, kind string, title string, content string, tags array<string>, related_files array<string>, related_symbols array<string>, pinned boolean, status string, supersedes string, created_at string, updated_at string",
    "annotations": "path string, purpose string, terms map<string,string>, content_hash string, annotated_at string",
    "embeddings": "id string, embedding array<float>, digest string",
    "commits": "hash string, ts timestamp, author string, message string",
    "commit_files": "hash string, path string, status string",
    "hunks": "path string, start int, end int",
    "usage_events": "command string, bytes_served long, raw_baseline long, ts timestamp",
}

#: Extension -> language, and the languages that are code.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "java": "java", "cs": "csharp", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "cpp", "hpp": "cpp", "hxx": "cpp",
    "hh": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown",
}
CODE = ("rust", "typescript", "javascript", "python", "go", "java", "csharp", "kotlin", "c", "cpp")
#: Budget -> results, snippet lines, rationale items, memories listed, history entries, conflict clusters.
BUDGETS = {
    "tiny": (3, 0, 0, 3, 3, 1),
    "small": (5, 20, 2, 5, 5, 2),
    "medium": (8, 40, 4, 10, 10, 3),
    "full": (12, 100, 8, 25, 20, 5),
}
RATIONALE_AUTO = 3


def top_k(budget: str) -> int:
    return BUDGETS[budget][0]


def resolve_budget(budget: str, files: int) -> str:
    """auto: medium up to 100 files, else small."""
    return budget if budget != "auto" else ("medium" if files <= 100 else "small")


@dataclass(frozen=True)
class Weights:
    """What the strategies of a context question weigh; each can be set for a run."""

    exact_name: float = 1.0
    file_symbols: float = 0.5
    import_neighbours: float = 0.4
    expanded: float = 0.6
    siblings: float = 0.4
    test_demotion: float = 0.5
    vector_score: float = 0.6
    vector_strong_score: float = 0.9
    vector_min_score: float = 0.65
    same_file_decay: float = 0.5
    same_dir_decay: float = 0.85


@dataclass(frozen=True)
class IndexConfig:
    """How a tree is indexed. ignore: names or globs; languages: None for all."""

    languages: tuple[str, ...] | None = None
    index_hidden: bool = False
    follow_symlinks: bool = False
    ignore: tuple[str, ...] = (".git", "node_modules", "target", "dist", "build", ".venv", "__pycache__")
    max_file_bytes: int = 2 << 20
    max_symbols_per_file: int = 10_000
    cross_file_calls_only: bool = True
    max_caller_files: int = 25

"""Source trees: scanning, read gates, fingerprints. Listings are the driver's; the listed files are read by the executors."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import LANGUAGES, IndexConfig

#: Extensions of files whose contents are never read.
ASSETS = (
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "tiff", "tif", "heic", "avif", "mp4", "mov", "avi", "mkv", "webm", "mp3", "wav", "flac", "ogg", "m4a", "aac",
    "zip", "tar", "gz", "tgz", "bz2", "xz", "zst", "7z", "rar", "pdf", "woff", "woff2", "ttf", "otf", "eot", "bin", "dat", "wasm", "exe", "dll", "so", "dylib", "o", "a", "class", "jar",
    "sqlite", "db", "mdb", "onnx", "pt", "pth", "safetensors", "gguf", "npy", "npz", "parquet",
)
SNIFF = 8192
#: Files that one reading task gets, about.
FILES_A_TASK = 256

#: A rule of an ignore file: where it holds, its pattern, whether it is for folders alone, whether it takes back.
Rule = tuple[str, re.Pattern, bool, bool]


def as_pattern(glob: str) -> re.Pattern:
    """A glob of an ignore file: * and ? stay within a folder, ** goes through folders; one without a slash fits at any depth."""
    anchored = "/" in glob.rstrip("/")
    out = ""
    for piece in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", glob.strip("/")):
        if piece == "**/":
            out += "(?:.*/)?"
        elif piece in ("/**", "**"):
            out += ("/" if piece[0] == "/" else "") + ".*"
        elif piece == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif piece[0] == "[" and len(piece) > 2:
            out += "[" + piece[1:-1].replace("!", "^", 1) + "]" if piece[1] == "!" else piece
        else:
            out += re.escape(piece)
    return re.compile(("" if anchored else "(?:.*/)?") + out)


def rules_of(lines: Iterable[str], base: str = "") -> list[Rule]:
    """The rules of an ignore file's lines, in order; base: its folder."""
    out = []
    for line in lines:
        line = line.rstrip("\r\n")
        text = line.rstrip() if not line.endswith("\\ ") else line
        if not text or text.startswith("#"):
            continue
        keep = text.startswith("!")
        text = text[1:] if keep or text.startswith(("\\#", "\\!")) else text
        out.append((base, as_pattern(text), text.endswith("/"), keep))
    return out


def ignore_file(folder: Path, base: str) -> list[Rule]:
    file = folder / ".gitignore"
    return rules_of(file.read_text(errors="replace").splitlines(), base) if file.is_file() else []


def global_rules(root: Path) -> list[Rule]:
    """The rules of the user's excludes file and of the repository's own, the weakest first."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    files = [Path(home, "git", "ignore"), root / ".git" / "info" / "exclude"]
    return [r for f in files if f.is_file() for r in rules_of(f.read_text(errors="replace").splitlines())]


def ignored(rel: str, rules: list[Rule], config: IndexConfig, folder: bool = False) -> bool:
    """Hidden parts, the configuration's names and globs, then the last rule that fits."""
    parts = rel.split("/")
    if not config.index_hidden and any(p.startswith(".") and p not in (".", "..") for p in parts):
        return True
    if any(any(fnmatch.fnmatchcase(p, i) for p in parts) if "/" not in i else as_pattern(i).fullmatch(rel) for i in config.ignore):
        return True
    for base, pattern, folders, keep in reversed(rules):
        if (folder or not folders) and rel.startswith(base) and pattern.fullmatch(rel[len(base) :]):
            return not keep
    return False


def wanted_language(name: str, config: IndexConfig) -> bool:
    """Whether a file's language is among those to index; a file of no known language always is."""
    language = LANGUAGES.get(name.rpartition(".")[2].lower()) if "." in name else None
    return config.languages is None or language is None or language in config.languages


def scan_tree(root: str | Path, config: IndexConfig | None = None, depth: int | None = None, start: str = "") -> list[tuple[str, int, float]]:
    """(path, size, mtime) of the files below root that the rules leave, sorted; depth 1 looks at one folder alone.

    start: a folder below root to begin at; the rules of the folders above it hold as well. Links are followed only
    where the configuration says so.
    """
    config, root = config or IndexConfig(), Path(root)
    rules, out = {"": global_rules(root) + ignore_file(root, "")}, []
    above = ""
    for part in [p for p in start.strip("/").split("/") if p]:
        here = f"{above}{part}/"
        rules[here] = rules[above] + ignore_file(root / here, here)
        above = here
    for folder, dirs, names in os.walk(root / above, followlinks=config.follow_symlinks):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        here = "" if rel == "." else rel + "/"
        if here not in rules:
            rules[here] = rules[here[: here.rstrip("/").rfind("/") + 1]] + ignore_file(Path(folder), here)
        own = rules[here]
        deep = here[len(above) :].count("/") + 1
        dirs[:] = [] if depth and deep >= depth else sorted(d for d in dirs if not ignored(here + d, own, config, folder=True))
        for n in sorted(names):
            full = os.path.join(folder, n)
            if not ignored(here + n, own, config) and wanted_language(n, config) and (config.follow_symlinks or not os.path.islink(full)) and os.path.isfile(full):
                st = os.stat(full)
                out.append((here + n, st.st_size, st.st_mtime))
    return sorted(out)


def read_tree(spark: SparkSession, root: str, config: IndexConfig | None = None, paths: list[str] | None = None) -> DataFrame:
    """(path, size, content, state) of a tree: state full, or why there is no content: asset, oversize, binary, missing.

    Only listed files are opened, and of these none that the gates leave out. The folder must be one that the executors
    see. paths: these files alone, where the rules leave them.
    """
    config = config or IndexConfig()
    if paths is None:
        listed = [(p, s) for p, s, _ in scan_tree(root, config)]
    else:
        folders = {f for f in {os.path.dirname(p) for p in paths} if os.path.isdir(os.path.join(root, f)) and not shut_out(f, root, config)}
        listed = [(p, s) for f in sorted(folders) for p, s, _ in scan_tree(root, config, 1, f) if p in set(paths)]
    files = spark.createDataFrame(listed, "path string, size long").repartition(max(1, -(-len(listed) // FILES_A_TASK)))
    base, most, assets = os.path.abspath(root), config.max_file_bytes, frozenset(ASSETS)

    def body(path: str, size: int) -> bytes | None:
        name = path.rpartition("/")[2]
        if size > most or ("." in name and name.rpartition(".")[2].lower() in assets):
            return None
        try:
            with open(os.path.join(base, path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(content=[body(p, s) for p, s in zip(rows["path"], rows["size"], strict=True)])

    return gated(files.mapInPandas(read, "path string, size long, content binary"), config)


def shut_out(folder: str, root: str, config: IndexConfig) -> bool:
    """Whether a folder below root, or one above it, is ignored."""
    parts, rules, here = [p for p in folder.split("/") if p], global_rules(Path(root)) + ignore_file(Path(root), ""), ""
    for p in parts:
        if ignored(here + p, rules, config, folder=True):
            return True
        here += p + "/"
        rules = rules + ignore_file(Path(root, here), here)
    return False


def gated(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """rows (path, size, content binary) with state, and content as text where it is full."""
    asset = F.lower(C.extension(F.col("path"))).isin(*ASSETS)
    binary = F.hex(F.substring("content", 1, SNIFF)).rlike("^(..)*?00")
    state = F.when(asset, "asset").when(F.col("size") > config.max_file_bytes, "oversize").when(F.col("content").isNull(), "missing").when(binary, "binary").otherwise("full")
    return rows.withColumn("state", state).withColumn("content", F.when(F.col("state") == "full", F.col("content").cast("string")))


def file_entries(rows: DataFrame) -> DataFrame:
    """The files table of gated() rows: content hash as id, or a hash of the path for what was not read."""
    hash_ = F.when(F.col("state") == "full", F.sha2("content", 256)).otherwise(F.concat(F.lit("skip:"), F.col("size").cast("string")))
    key = F.when(F.col("state") == "full", F.col("hash")).otherwise(F.sha2("path", 256))
    return rows.withColumn("hash", hash_).select(
        F.concat(F.lit("f:"), F.substring(key, 1, 12)).alias("id"), "path", C.extension(F.col("path")).alias("extension"), C.language_of(F.col("path")).alias("language"),
        "size", "hash", F.current_timestamp().alias("indexed_at"), C.file_tags(F.col("path")).alias("tags"), F.lit(None).cast("string").alias("purpose"), F.lit(None).cast("string").alias("purpose_source"),
    )


def staleness(listing: DataFrame, known: DataFrame, scanned_at: float) -> DataFrame:
    """(path, why): what a new listing (path, size, mtime) has against a known one: new, missing, touched since the scan.

    A time in the future says nothing and is passed over.
    """
    joined = listing.join(known.select(F.col("path").alias("known"), F.col("size").alias("known_size")), F.col("path") == F.col("known"), "full")
    now = F.unix_timestamp().cast("double")
    touched = (F.col("mtime") >= scanned_at) & (F.col("mtime") <= now)
    why = F.when(F.col("known").isNull(), "new").when(F.col("path").isNull(), "missing").when((F.col("size") != F.col("known_size")) | touched, "touched")
    return joined.select(F.coalesce("path", "known").alias("path"), why.alias("why")).filter("why is not null")

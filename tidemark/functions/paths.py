"""Path filters, file types and languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .patterns import matches

# ---- fixed values: binary extensions, content types by extension, languages by extension ----

BINARY_EXTENSIONS = (".exe", ".so", ".dll", ".bin", ".obj", ".o", ".a", ".lib", ".dylib")

CONTENT_TYPES = {
    ".py": "text/x-python",
    ".go": "text/x-go",
    ".js": "application/javascript",
    ".ts": "application/typescript",
    ".java": "text/x-java",
    ".cpp": "text/x-c++",
    ".c": "text/x-c",
    ".h": "text/x-c",
    ".hpp": "text/x-c++",
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".rst": "text/x-rst",
    ".yaml": "application/x-yaml",
    ".yml": "application/x-yaml",
    ".json": "application/json",
    ".toml": "application/toml",
    ".xml": "application/xml",
    ".html": "text/html",
    ".css": "text/css",
    ".sql": "application/sql",
    ".sh": "application/x-sh",
    ".bash": "application/x-sh",
}

DEFAULT_CONTENT_TYPE = "text/plain"

LANGUAGES = {
    ".sh": "bash",
    ".bash": "bash",
    ".c": "c",
    ".h": "c",
    ".cs": "c_sharp",
    ".lisp": "commonlisp",
    ".lsp": "commonlisp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".css": "css",
    ".dockerfile": "dockerfile",
    "Dockerfile": "dockerfile",
    ".dot": "dot",
    ".el": "elisp",
    ".ex": "elixir",
    ".exs": "elixir",
    ".elm": "elm",
    ".ejs": "embedded_template",
    ".erl": "erlang",
    ".hrl": "erlang",
    ".f": "fixed_form_fortran",
    ".for": "fixed_form_fortran",
    ".f90": "fortran",
    ".f95": "fortran",
    ".go": "go",
    ".mod": "gomod",
    "go.mod": "gomod",
    ".hack": "hack",
    ".hs": "haskell",
    ".hcl": "hcl",
    ".tf": "hcl",
    ".html": "html",
    ".htm": "html",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".jsdoc": "jsdoc",
    ".json": "json",
    ".jl": "julia",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".lua": "lua",
    ".mk": "make",
    "Makefile": "make",
    ".md": "markdown",
    ".m": "objc",
    ".mm": "objc",
    ".ml": "ocaml",
    ".mli": "ocaml",
    ".pl": "perl",
    ".pm": "perl",
    ".php": "php",
    ".py": "python",
    ".ql": "ql",
    ".r": "r",
    ".regex": "regex",
    ".rst": "rst",
    ".rb": "ruby",
    ".rs": "rust",
    ".scala": "scala",
    ".sc": "scala",
    ".sql": "sql",
    ".sqlite": "sqlite",
    ".db": "sqlite",
    ".toml": "toml",
    ".tsq": "tsq",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".yaml": "yaml",
    ".yml": "yaml",
}

# ---- end of fixed values ----

NAMED_FILES = tuple(key for key in LANGUAGES if not key.startswith("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The extension with its dot, in the case it is written; empty when there is none.

    Leading dots belong to the name: ``.bashrc`` has no extension.
    """
    return F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def is_hidden(path: Column) -> Column:
    """Some segment starts with a dot."""
    return path.rlike(r"(?:^|/)\.")


def is_binary_name(path: Column) -> Column:
    return F.lower(extension(path)).isin(*BINARY_EXTENSIONS)


def keep_path(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """The path filter as a predicate; an exclude match wins over an include match."""
    keep = ~is_hidden(path) & ~is_binary_name(path)
    if exclude:
        keep = keep & ~matches(path, exclude)
    if include:
        keep = keep & matches(path, include)
    return keep


def filter_paths(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), path: str = "path"
) -> DataFrame:
    return df.where(keep_path(F.col(path), include, exclude))


def file_types(spark: SparkSession) -> DataFrame:
    """The fixed lookup table: key, content type, language (77 rows at most)."""
    keys = dict.fromkeys([*CONTENT_TYPES, *LANGUAGES])

    def quoted(value: str | None) -> str:
        return "CAST(NULL AS STRING)" if value is None else f"'{value}'"

    rows = ", ".join(
        f"({quoted(k)}, {quoted(CONTENT_TYPES.get(k))}, {quoted(LANGUAGES.get(k))})" for k in keys
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(type_key, content_type, language)")


def with_file_type(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``ext, content_type, language, split_type``.

    The lookup table is fixed and tiny, so it is broadcast; the frame itself is not shuffled.
    A content type the frame already has (such as a response header) is kept.
    """
    p = F.col(path)
    key = F.when(basename(p).isin(*NAMED_FILES), basename(p)).otherwise(F.lower(extension(p)))
    types = file_types(df.sparkSession)
    if "content_type" in df.columns:
        types = types.drop("content_type")
    out = (
        df.withColumn("ext", extension(p))
        .withColumn("type_key", key)
        .join(F.broadcast(types), "type_key", "left")
        .drop("type_key")
        .withColumn("split_type", F.when(F.col("language").isNotNull(), F.lit("code")))
    )
    if "content_type" not in df.columns:
        out = out.withColumn(
            "content_type", F.coalesce("content_type", F.lit(DEFAULT_CONTENT_TYPE))
        )
    return out

"""Paths and addresses: which files are indexed, in what order, and where they belong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is indexed, what is left out, and the languages of extensions.
INDEXED = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "java", "c", "cpp", "h", "hpp", "md", "mdx", "txt", "json", "yaml", "yml", "toml", "css", "scss", "html", "vue", "svelte")
LEFT_OUT = ("node_modules/", ".git/", "dist/", "build/")
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "py": "python",
    "rs": "rust", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
}


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; without a dot the whole path."""
    return F.lower(F.substring_index(path, ".", -1))


def is_indexable(path: Column) -> Column:
    out = ~F.contains(path, F.lit("__pycache__/"))
    for p in LEFT_OUT:
        out = out & ~F.startswith(path, F.lit(p))
    return out & extension(path).isin(*INDEXED)


def language(path: Column) -> Column:
    """Null where the extension is of no known language."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def priority(path: Column) -> Column:
    """The introduction first, then sources, then the rest."""
    low = F.lower(path)
    return F.when(low.isin("readme.md", "readme"), 0).when(F.startswith(low, F.lit("src/")) | F.startswith(low, F.lit("lib/")), 1).otherwise(2)


def directory(path: Column, root: str = ".") -> Column:
    """The path up to the last slash, or ``root`` where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise(F.lit(root))


def repository(url: Column) -> tuple[Column, Column]:
    """Owner and name of a repository's address."""
    pattern = r"github\.com/([^/\s]+)/([^/\s?#]+)"
    return F.regexp_extract(url, pattern, 1), F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")


def blob_parts(url: Column) -> dict[str, Column]:
    """Parts of the address of a file at a revision, with its lines where it names them."""
    pattern = r"github\.com/([^/]+)/([^/]+)/blob/([^/]+)/([^#]+)(?:#L([0-9]+)(?:-L([0-9]+))?)?"
    names = ("owner", "repo", "ref", "path", "first_line", "last_line")
    return {n: F.regexp_extract(url, pattern, i + 1) for i, n in enumerate(names)}


def line_span(text: Column, first: Column, last: Column, least: int = 30, most: int = 2000) -> Column:
    """The lines of a text from ``first`` to ``last``, cut at ``most`` characters; null where fewer than ``least`` are left."""
    span = F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(F.lit(1), last - first + 1)), "\n")
    return F.when(F.length(span) >= least, F.substring(span, 1, most))

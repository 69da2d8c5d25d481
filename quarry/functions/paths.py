"""Columns about paths: extensions, file types, ignored folders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by file type, those with a parser, ignored folder names.
FILE_TYPES = {
    "text": "txt md markdown csv json xml html htm rst toml yaml yml log ini conf py rs js ts go java c cpp h css sh bat".split(),
    "pdf": ["pdf"],
    "image": "jpg jpeg png bmp gif webp tiff tif svg heic heif".split(),
    "audio": "mp3 wav flac aac ogg m4a wma opus".split(),
    "video": "mp4 avi mov mkv webm flv wmv m4v".split(),
}
PARSED = {
    "text": [*FILE_TYPES["text"], "sql"],
    "pdf": ["pdf"],
    "image": "jpg jpeg png bmp gif webp tiff tif heic heif".split(),
    "audio": FILE_TYPES["audio"],
    "video": FILE_TYPES["video"],
}
IGNORED = (
    ".git .svn .hg .bzr node_modules bower_components jspm_packages .npm .yarn .pnp __pycache__ .venv venv env .tox .pytest_cache .mypy_cache .ruff_cache .eggs "
    "target .gradle .m2 build Pods DerivedData .build dist out .next .nuxt .output .cache .parcel-cache .turbo .svelte-kit coverage .nyc_output .idea .vscode .vs .eclipse "
    "$RECYCLE.BIN .Spotlight-V100 .Trashes .fseventsd vendor __generated__ .terraform .vagrant tmp temp log logs"
).split() + ["System Volume Information"]


def extension(path: Column) -> Column:
    """Lower-cased extension of the last component; empty without one, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def file_type(ext: Column) -> Column:
    """text, pdf, image, audio, video or unknown, of an extension in any case."""
    known = F.create_map(*[F.lit(x) for kind, exts in FILE_TYPES.items() for e in exts for x in (e, kind)])
    return F.coalesce(F.element_at(known, F.lower(ext)), F.lit("unknown"))


def parser_kind(ext: Column) -> Column:
    """The parser for an extension, or null."""
    known = F.create_map(*[F.lit(x) for kind, exts in PARSED.items() for e in exts for x in (e, kind)])
    return F.element_at(known, F.lower(ext))


def is_supported(path: Column) -> Column:
    return parser_kind(extension(path)).isNotNull()


@dataclass(frozen=True)
class IgnoreConfig:
    """Names of folders that are skipped, beside those that begin with a dot."""

    names: frozenset[str] = field(default_factory=lambda: frozenset(IGNORED))

    @classmethod
    def empty(cls) -> IgnoreConfig:
        return cls(frozenset())

    def with_extra(self, *names: str) -> IgnoreConfig:
        return IgnoreConfig(self.names | set(names))

    def allow(self, *names: str) -> IgnoreConfig:
        return IgnoreConfig(self.names - set(names))

    def skips(self, name: str) -> bool:
        return name.startswith(".") or name in self.names

    def _skipped(self, parts: Column) -> Column:
        return F.exists(parts, lambda p: p.startswith(".") | p.isin(*sorted(self.names)))

    def ignored_dir(self, relative: Column) -> Column:
        """Whether a folder above the file, below the scan's root, is skipped."""
        parts = F.filter(F.split(relative, "/"), lambda p: p != "")
        return self._skipped(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))

    def ignored_path(self, relative: Column) -> Column:
        """Whether any component, the file's own name too, is skipped."""
        return self._skipped(F.filter(F.split(relative, "/"), lambda p: (p != "") & (p != ".")))


def relative_to(path: Column, root: str) -> Column:
    """The path below a root; without a scheme."""
    plain = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    bare = root.split(":", 1)[-1] if "://" in root or root.startswith("file:") else root
    return F.substring(plain, len("/" + bare.strip("/")) + 2, 1 << 30)

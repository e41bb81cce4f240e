"""Which files are documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the kind of document each one is.
EXTENSIONS = {
    "pdf": "pdf",
    "doc": "word", "docx": "word", "docm": "word", "dot": "word", "dotx": "word", "odt": "word", "rtf": "word",
    "xls": "excel", "xlsx": "excel", "xlsm": "excel", "xlsb": "excel", "csv": "excel", "ods": "excel",
    "ppt": "slides", "pptx": "slides", "pptm": "slides", "pps": "slides", "ppsx": "slides", "odp": "slides",
    "txt": "text", "md": "text",
}
# Formats that are off until chosen, formats without readable text, prefixes of lock files.
OPT_IN = ("txt", "md")
NO_TEXT = ("doc", "dot", "ppt", "pps")
LOCK_PREFIXES = ("~$", ".~lock", "~WRL")


def kind_of(ext: Column) -> Column:
    """Null for an unknown extension."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, ext)


def extension(name: Column) -> Column:
    """After the last dot, A-Z lower-cased; empty without a dot."""
    return F.translate(F.regexp_extract(name, r"\.([^.]*)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_lock_file(name: Column) -> Column:
    out = F.lit(False)
    for p in LOCK_PREFIXES:
        out = out | F.startswith(name, F.lit(p))
    return out


def is_other_file(name: Column) -> Column:
    """Clearly another type of file: a stem, and an extension of 1 to 5 ASCII letters or digits, one letter at least, that isn't a document's."""
    shaped = F.rlike(name, F.lit(r"(?s)^.+\.[0-9A-Za-z]{1,5}$")) & F.rlike(name, F.lit(r"\.[0-9]*[A-Za-z][0-9A-Za-z]*$"))
    return shaped & kind_of(extension(name)).isNull()


def is_enabled(ext: Column, disabled: tuple[str, ...] = (), opted_in: tuple[str, ...] = ()) -> Column:
    """Known extensions that aren't disabled; opt-in formats only when opted in. Unknown names among the settings have no effect."""
    off = [e for e in disabled if e in EXTENSIONS] + [e for e in OPT_IN if e not in opted_in]
    known = kind_of(ext).isNotNull()
    return known & ~ext.isin(off) if off else known


def reads_text(ext: Column) -> Column:
    return kind_of(ext).isNotNull() & ~ext.isin(*NO_TEXT)

"""File names: extension and MIME type."""
from pyspark.sql import Column, functions as F

from coverlens import fixed_values as V
from coverlens.functions.text import as_col


def file_extension(path) -> Column:
    """Lower-case suffix of the file name without the dot, '' when it has none."""
    name = F.element_at(F.split(as_col(path), "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def mime_type(path, kind="storage") -> Column:
    known = V.STORAGE_MIME if kind == "storage" else V.MODEL_MIME
    ext = file_extension(path)
    out = F
    for e, mime in known.items():
        out = out.when(ext == e, F.lit(mime))
    return out.otherwise(F.lit(V.DEFAULT_MIME))

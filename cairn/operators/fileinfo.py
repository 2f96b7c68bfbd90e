"""What is known of requested files (E5), as rows: a hub's importers and callers may be any number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import is_script

#: Columns of a part and their types; a part fills those that it has.
COLUMNS = {"name": "string", "kind": "string", "is_default": "boolean", "exported": "boolean", "container": "string", "other_path": "string", "other_name": "string", "line": "int"}


def file_info(resolved: DataFrame, edges: DataFrame, found: DataFrame, calls: DataFrame) -> DataFrame:
    """(request, path, part, name, kind, is_default, exported, container, other_path, other_name, line).

    resolved comes from resolve_paths with files expected. Each request has one row of part `file` (kind `file` or
    `missing`; name is `limited` where symbols and calls are not known for the language), and rows of the parts `suggestion`, `symbol`
    (exports are the exported ones), `import`, `imported_by`, `call` (name is the export, line in this file) and `called_by`
    (line in the other file).
    """
    asked = resolved.select("request", "path", "found", "suggestions")
    own = asked.filter("found").select("request", "path")

    def part(rows: DataFrame, label: str, /, **values) -> DataFrame:
        filled = [values[c].cast(t).alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()]
        return rows.select("request", "path", F.lit(label).alias("part"), *filled)

    c = F.col
    exports = found.filter("exported").select("path", "name").distinct()
    parts = [
        part(asked, "file", kind=F.when(c("found"), "file").otherwise("missing"), name=F.when(~is_script(c("path")), "limited")),
        part(asked.select("request", "path", F.explode("suggestions").alias("s")), "suggestion", other_path=c("s")),
        part(own.join(found, "path"), "symbol", **{k: c(k) for k in ("name", "kind", "is_default", "exported", "container", "line")}),
        part(own.join(edges, c("path") == c("src")), "import", other_path=c("dst")),
        part(own.join(edges, c("path") == c("dst")), "imported_by", other_path=c("src")),
        part(own.join(calls.withColumnRenamed("symbol", "name").join(exports, ["path", "name"], "left_semi"), "path"), "call", name=c("name"), other_path=c("to_path"), other_name=c("to_symbol"), line=c("line")),
        part(own.join(calls.select(c("path").alias("from"), "symbol", "line", c("to_path").alias("path"), c("to_symbol").alias("name")).join(exports, ["path", "name"], "left_semi"), "path"), "called_by", name=c("name"), other_path=c("from"), other_name=c("symbol"), line=c("line")),
    ]
    return reduce(DataFrame.unionByName, parts)

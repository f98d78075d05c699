"""Field drift between successive JSON files, and their union into one table.

Names that go and names that come between two files of a feed are matched by similarity
flooding over the two schema graphs; the correspondences it selects are confirmed on the
values, and then every file is read under one set of names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.operators.common import cut, salted_join

#: Share of the common tasks whose value must agree under both names.
AGREEMENT = 0.9
FILE = ["feed_code", "file_no"]


def parsed(feed: DataFrame) -> DataFrame:
    """feed_code, file_no, row_no, task_id and ``cells``: name, type, value of every field.

    Types are string, boolean, integer, decimal, object, array, and null type for a null.
    A payload that is no JSON object has no cells.
    """
    v = F.from_json("payload", "map<string,variant>")
    cells = F.transform(F.map_entries(v), lambda e: F.struct(e["key"].alias("name"), _type(F.schema_of_variant(e["value"])).alias("type"), e["value"].cast("string").alias("val")))
    rows = feed.select(*FILE, "row_no", F.coalesce(cells, F.array().cast("array<struct<name:string,type:string,val:string>>")).alias("cells"))
    own = F.get(F.filter("cells", lambda c: c["name"] == "task_id"), F.lit(0))
    return rows.withColumn("task_id", F.btrim(own["val"], F.lit(" \t")))


def _type(kind: Column) -> Column:
    return (
        F.when(kind.isin("BIGINT"), "integer").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "decimal").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
    )


def file_schemas(rows: DataFrame) -> DataFrame:
    """One row per file: its number of predecessors and its fields with the types of their values.

    A schema is as wide as a file has distinct names, which bounds every array here.
    """
    cell = F.explode_outer("cells")
    fields = rows.select(*FILE, cell.alias("c")).groupBy(*FILE, F.col("c.name").alias("name")).agg(F.array_sort(F.collect_set("c.type")).alias("types"))
    return fields.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "types")))).alias("fields"))


def file_pairs(schemas: DataFrame) -> DataFrame:
    """Each file with the one before it in the feed; names that go, come and stay."""
    before = Window.partitionBy("feed_code").orderBy("file_no")
    pairs = schemas.select(*FILE, "fields", F.lag("file_no").over(before).alias("old_no"), F.lag("fields").over(before).alias("old_fields")).where(F.col("old_no").isNotNull())
    has = lambda fields, f: F.exists(fields, lambda x: x["name"] == f["name"])
    return pairs.select(
        "*",
        F.filter("old_fields", lambda f: ~has("fields", f)).alias("goes"),
        F.filter("fields", lambda f: ~has("old_fields", f)).alias("comes"),
    )


def agreement(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per file pair and (gone, come) name: tasks with a value under either name, and equal ones.

    Only pairs of files with both gone and come names are read, and of those only one row per
    task. The expansion is (gone x come) per task, bounded by the width of the schemas.
    """
    todo = pairs.where((F.size("goes") > 0) & (F.size("comes") > 0)).select("feed_code", F.col("file_no").alias("new_no"), "old_no", F.col("goes.name").alias("goes"), F.col("comes.name").alias("comes"))
    each = rows.where(F.col("task_id").isNotNull())
    held = lambda names: F.map_from_entries(F.transform(F.filter("cells", lambda c: F.array_contains(names, c["name"]) & c["type"].isNotNull()), lambda c: F.struct(c["name"], F.concat_ws(":", c["type"], c["val"]))))
    key = ["feed_code", "new_no", "task_id"]

    def side(no: str, names: str, out: str) -> DataFrame:
        marks = todo.select("feed_code", F.col(no).alias("file_no"), "new_no", names)
        return salted_join(each, marks, FILE, None, F.col("task_id"), "inner", salts=8).select(*key, "row_no", held(F.col(names)).alias(out)).groupBy(*key).agg(F.min_by(out, "row_no").alias(out))

    both = side("old_no", "goes", "old").join(side("new_no", "comes", "new"), key)
    pairs_of = todo.select("feed_code", "new_no", F.explode("goes").alias("gone"), "comes").withColumn("come", F.explode("comes")).drop("comes")
    joined = salted_join(both, pairs_of, ["feed_code", "new_no"], None, F.col("task_id"), "inner", salts=8)
    a, b = F.element_at("old", F.col("gone")), F.element_at("new", F.col("come"))
    return joined.groupBy("feed_code", "new_no", "gone", "come").agg(
        F.count_if(a.isNotNull() | b.isNotNull()).alias("n"), F.count_if(a == b).alias("same")
    )


def _grams(s: str) -> set[str]:
    s = f"^{s.lower()}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def flood(goes: list[tuple[str, list[str]]], comes: list[tuple[str, list[str]]], known: dict[tuple[str, str], float], rounds: int = 60, least: float = 1e-4) -> dict[tuple[str, str], float]:
    """Fixpoint scores of (gone, come) name pairs.

    Nodes of the propagation graph are pairs of like nodes: the two file roots, two names or
    two types. A pair passes its score along equal edge labels (``field``, ``type``), shared
    out over the edges of that label. Names start at the similarity of their letters and, where
    values are known, the share of agreeing ones; types start at their equality.
    """
    root = ("", "")
    start: dict[tuple, float] = {("root", *root): 1.0}
    edges: dict[tuple, dict[tuple, float]] = {}
    kinds = {"integer": 1, "decimal": 1, "string": 2, "boolean": 3}

    def link(x: tuple, ys: list[tuple]) -> None:
        for y in ys:
            edges.setdefault(x, {})[y] = edges.get(x, {}).get(y, 0) + 1 / len(ys)
            edges.setdefault(y, {})[x] = edges.get(y, {}).get(x, 0) + 1 / len(ys)

    names = []
    for g, gt in goes:
        for c, ct in comes:
            a, b = _grams(g), _grams(c)
            node = ("name", g, c)
            start[node] = 0.3 * len(a & b) / len(a | b) + 0.7 * known.get((g, c), 0.0)
            names.append(node)
            types = [("type", x, y) for x in gt for y in ct]
            for t in types:
                start[t] = 1.0 if t[1] == t[2] else 0.4 if kinds.get(t[1]) == kinds.get(t[2]) else 0.1
            if types:
                link(node, types)
    link(("root", *root), names)
    score = dict(start)
    for _ in range(rounds):
        nxt = {n: start[n] + score[n] + sum(w * score[m] for m, w in edges.get(n, {}).items()) for n in score}
        top = max(nxt.values())
        nxt = {n: v / top for n, v in nxt.items()}
        moved = max(abs(nxt[n] - score[n]) for n in nxt)
        score = nxt
        if moved < least:
            break
    return {(n[1], n[2]): score[n] for n in names}


MATCHED = "feed_code string, file_no int, gone string, come string, score double"


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Selected correspondences of each file pair: best score first, each name once."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            seen = {(x["gone"], x["come"]): (x["n"], x["same"]) for x in r.seen}
            known = {k: same / n for k, (n, same) in seen.items() if n}
            fields = lambda xs: [(x["name"], list(x["types"])) for x in xs]
            scores = flood(fields(r.goes), fields(r.comes), known)
            done: set[str] = set()
            for (g, c), s in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0])):
                n, same = seen.get((g, c), (0, 0))
                # The exact check that follows the matching.
                if "-" + g in done or "+" + c in done or not n or same < AGREEMENT * n:
                    continue
                done |= {"-" + g, "+" + c}
                out.append((r.feed_code, r.file_no, g, c, s))
        yield pd.DataFrame(out, columns=["feed_code", "file_no", "gone", "come", "score"])


def renames(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """feed_code, file_no (the later file), gone and come name, and the flooding's score."""
    seen = agreement(rows, pairs).groupBy("feed_code", F.col("new_no").alias("file_no")).agg(F.collect_list(F.struct("gone", "come", "n", "same")).alias("seen"))
    return pairs.join(seen, FILE).select(*FILE, "goes", "comes", "seen").mapInPandas(_match, MATCHED)


def schema_changes(feed: DataFrame) -> DataFrame:
    """feed_code, file_no, field_name, kind: renamed, removed, added, retyped.

    Each file is compared with the one before it in its feed, by file_no. A name that goes
    and one that comes are one renamed field (under its new name) if the matching selects
    them and at least nine tenths of the tasks in both files with a value under either name
    have the same value of the same type under both. A field that is only null in one of the
    files is never retyped. Repeated rows change nothing; a feed's first file, and an empty
    table, give no changes.
    """
    rows = cut(parsed(feed))
    pairs = cut(file_pairs(file_schemas(rows)))
    return changes_of(pairs, cut(renames(rows, pairs)))


def changes_of(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    told = matched.groupBy(*FILE).agg(F.collect_list("gone").alias("gone"), F.collect_list("come").alias("come"))
    none = F.array().cast("array<string>")
    wide = pairs.join(told, FILE, "left").withColumns({"gone": F.coalesce("gone", none), "come": F.coalesce("come", none)})
    old_types = lambda f: F.get(F.filter("old_fields", lambda o: o["name"] == f["name"]), F.lit(0))["types"]
    retyped = F.filter("fields", lambda f: (F.size(f["types"]) > 0) & (F.coalesce(F.size(old_types(f)), F.lit(0)) > 0) & (f["types"] != old_types(f)))
    tell = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("field_name"), F.lit(kind).alias("kind")))
    name = lambda xs: F.transform(xs, lambda f: f["name"])
    every = F.concat(
        tell(F.col("come"), "renamed"),
        tell(F.array_except(name(F.col("goes")), F.col("gone")), "removed"),
        tell(F.array_except(name(F.col("comes")), F.col("come")), "added"),
        tell(name(retyped), "retyped"),
    )
    return wide.select(*FILE, F.inline(every))


def _replay(key: tuple, files: pd.DataFrame, matched: pd.DataFrame) -> pd.DataFrame:
    """The fields of one feed, file by file: names that are not the field's first name."""
    renamed: dict[int, list[tuple[str, str]]] = {}
    for r in matched.itertuples(index=False):
        renamed.setdefault(r.file_no, []).append((r.gone, r.come))
    out, now, past = [], {}, {}
    for r in files.sort_values("file_no").itertuples(index=False):
        moved = renamed.get(r.file_no, [])
        then = {n: now[n] for n in r.names if n in now} | {come: now[gone] for gone, come in moved}
        past |= now
        for gone, _ in moved:
            past.pop(gone, None)
        for n in sorted(n for n in r.names if n not in then):
            own = past.get(n, n)
            if own in then.values():
                own = f"{n}@{r.file_no}"
            while own in then.values():
                own += "'"
            then[n] = own
        now = then
        out += [(key[0], r.file_no, n, own) for n, own in now.items() if n != own]
    return pd.DataFrame(out, columns=["feed_code", "file_no", "name", "first_name"])


def canonical_names(schemas: DataFrame, matched: DataFrame) -> DataFrame:
    """feed_code, file_no, name, first_name: the name a renamed field had when it appeared.

    The files of a feed are followed in order, in one task: names and renames alone, so as
    many rows as the feed has files. A field that comes again keeps the name it had. If another
    field holds that by then (it was renamed, and the old name is given anew), the later one
    is called by its name and its file's number, as in ``crt_path_num@5``: no two fields
    of a file share a first name.
    """
    files = schemas.select(*FILE, F.col("fields.name").alias("names"))
    return files.groupBy("feed_code").cogroup(matched.groupBy("feed_code")).applyInPandas(_replay, "feed_code string, file_no int, name string, first_name string")


def _renamed(feed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed rows, the files' schemas, and each file's map from a field's name to its first name."""
    rows = cut(parsed(feed))
    schemas = cut(file_schemas(rows))
    pairs = cut(file_pairs(schemas))
    told = canonical_names(schemas, cut(renames(rows, pairs)))
    firsts = schemas.select(*FILE).join(told.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("name", "first_name"))).alias("firsts")), FILE, "left")
    return rows, schemas, cut(firsts)


def _united(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    first = lambda n: F.coalesce(F.element_at("firsts", n), n)
    cells = F.transform("cells", lambda c: F.struct(first(c["name"]).alias("name"), c["val"].alias("val")))
    one = F.aggregate(cells, F.create_map().cast("map<string,string>"), lambda m, c: F.when(F.map_contains_key(m, c["name"]), m).otherwise(F.map_concat(m, F.create_map(c["name"], c["val"]))))
    return salted_join(rows, firsts, FILE, None, F.col("task_id"), "left", salts=8).select(*FILE, "row_no", "task_id", one.alias("fields"))


def unified(feed: DataFrame) -> DataFrame:
    """All rows under one set of fields: feed_code, file_no, row_no, task_id and ``fields``.

    ``fields`` maps each field's first name in its feed to the value as text. A null value
    stays null. Every input row comes out once, repeated ones too.
    """
    rows, _, firsts = _renamed(feed)
    return _united(rows, firsts)


def united_types(schemas: DataFrame, firsts: DataFrame) -> DataFrame:
    """(field, type): the least type that all of a field's values in all feeds cast to: its only
    one, decimal for integer and decimal, and string for any others."""
    each = schemas.join(firsts, FILE, "left").select("firsts", F.explode("fields").alias("f"))
    kinds = each.groupBy(F.coalesce(F.element_at("firsts", F.col("f.name")), F.col("f.name")).alias("field")).agg(F.array_distinct(F.flatten(F.collect_set("f.types"))).alias("k"))
    only = F.filter("k", lambda x: ~x.isin("integer", "decimal"))
    return kinds.select("field", F.when(F.size("k") == 1, F.get("k", F.lit(0))).when((F.size("k") == 2) & (F.size(only) == 0), "decimal").otherwise("string").alias("type"))


def wide(feed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """All rows as one table: feed_code, file_no, row_no, task_id, a column of its united type
    (see :func:`united_types`) for each of ``fields``, and ``other_fields`` as a JSON object of text.

    A field that no file has is a null string. ``task_id`` is text, whatever its type.
    """
    rows, schemas, firsts = _renamed(feed)
    types = {r["field"]: r["type"] for r in united_types(schemas, firsts).where(F.col("field").isin(*fields)).collect()}  # as many as ``fields``
    sql = {"integer": "bigint", "decimal": "double", "boolean": "boolean"}
    rest = F.map_filter("fields", lambda k, _: ~k.isin("task_id", *fields))
    return _united(rows, firsts).select(*FILE, "row_no", "task_id", *[F.col("fields")[f].try_cast(sql.get(types.get(f, ""), "string")).alias(f) for f in fields], F.to_json(rest).alias("other_fields"))

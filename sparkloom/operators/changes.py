"""Change analysis: symbols of two versions, what a patch touches, seeds for the blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_symbols(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, kind, qualname, change, gap of the symbols of two inventories (parse_files) of renamed-alike paths.

    ADDED, REMOVED, SIGNATURE_CHANGED (the header differs), BODY_CHANGED; several symbols of one
    name are a gap and no change. One full outer join on aggregated keys.
    """
    key = ["path", "kind", "qualname"]
    side = lambda df, n: df.where("error IS NULL").groupBy(*key).agg(F.count("*").alias(f"n{n}"), F.min(F.struct("header_digest", "content_digest", "local_key", "complexity")).alias(f"s{n}"))
    both = side(base, 0).join(side(head, 1), key, "full_outer")
    gap = F.when((F.coalesce("n0", F.lit(0)) > 1) | (F.coalesce("n1", F.lit(0)) > 1), "AMBIGUOUS_SYMBOL_IDENTITY")
    change = F.when(F.col("s0").isNull(), "ADDED").when(F.col("s1").isNull(), "REMOVED").when(F.col("s0.header_digest") != F.col("s1.header_digest"), "SIGNATURE_CHANGED").when(F.col("s0.content_digest") != F.col("s1.content_digest"), "BODY_CHANGED")
    out = both.select(*key, F.when(gap.isNull(), change).alias("change"), gap.alias("gap"), F.col("s0.local_key").alias("base_key"), F.col("s1.local_key").alias("head_key"), F.col("s0.complexity").alias("old_complexity"), F.col("s1.complexity").alias("new_complexity"))
    return out.where("change IS NOT NULL OR gap IS NOT NULL")


def patch_gaps(files: DataFrame, texts: DataFrame) -> DataFrame:
    """path, code: entries of a patch that can't be mapped. files: path, status, binary, symlink, submodule. texts: path with sources."""
    known = texts.select("path", F.lit(True).alias("_has"))
    f = files.join(known, "path", "left")
    code = F.when(F.col("binary"), "BINARY_FILE").when(F.col("symlink") | F.col("submodule"), "NON_SOURCE_ENTRY").when(F.col("status") == "COPIED", "COPY_UNSUPPORTED").when(~F.col("path").endswith(".py"), "UNSUPPORTED_FILE_TYPE").when(F.col("_has").isNull(), "MISSING_SOURCE")
    return f.withColumn("code", code).where("code IS NOT NULL").select("path", "code")


def seeds(changes: DataFrame, bindings: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """(seeds: symbol_id; gaps: local_key) of one side's changed symbols. bindings: local_key, symbol_id, path, kind, qualname.

    A binding that names another symbol is an error, a missing one a gap.
    """
    key = f"{side}_key"
    own = changes.where(F.col("change").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("local_key"), "path", "kind", "qualname")
    met = own.join(bindings.withColumnsRenamed({"path": "_p", "kind": "_k", "qualname": "_q"}), "local_key", "left")
    wrong = met.where(F.col("symbol_id").isNotNull() & ~((F.col("_p") == F.col("path")) & (F.col("_k") == F.col("kind")) & F.col("_q").eqNullSafe(F.col("qualname"))))
    if (bad := wrong.limit(1).first()) is not None:
        raise ValueError(f"a binding names another symbol: {bad['local_key']}")
    return met.where("symbol_id IS NOT NULL").select("symbol_id").distinct(), met.where("symbol_id IS NULL").select("local_key")


def graph_plan(symbols: DataFrame, files: DataFrame, drafts: DataFrame, endpoints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a repository: a module a file, its symbols, endpoints; ids hashed from labels, edges merged.

    drafts: src_path, src_key, dst_path, dst_key, kind, confidence, references (reference_edges()).
    """
    from sparkloom.operators.writes import with_ids

    modules = files.select("path", F.lit(None).cast("string").alias("key"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("qualname"), F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    own = symbols.where("error IS NULL").select("path", F.col("local_key").alias("key"), "name", "qualname", "kind", "start_line", "end_line")
    nodes = modules.unionByName(own) if endpoints is None else modules.unionByName(own).unionByName(endpoints)
    nodes = with_ids(nodes.withColumn("_label", F.coalesce("key", F.lit("module"))), "symbol_id", "path", "_label").drop("_label")
    label = lambda p: [F.col("path").alias(f"{p}_path"), F.coalesce("key", F.lit("")).alias(f"_{p}"), F.col("symbol_id").alias(p)]
    d = drafts.withColumn("_src", F.coalesce("src_key", F.lit(""))).withColumn("_dst", F.coalesce("dst_key", F.lit("")))
    edges = d.join(nodes.select(*label("src")), ["src_path", "_src"]).join(nodes.select(*label("dst")), ["dst_path", "_dst"])
    merged = edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("references")))).alias("references"))
    return nodes, merged.withColumn("edge_id", F.xxhash64("src", "dst", "kind").bitwiseAND(F.lit((1 << 62) - 1)))


def families(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """class_id, family: families spread over exact base-class edges until nothing changes; a class that would get two has none.

    classes: class_id, family (null unknown). bases: class_id, base_id.
    """
    from sparkloom.lineage import cut

    known = cut(classes.where("family IS NOT NULL").select("class_id", "family").distinct())
    frontier, parts = known, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not frontier.isEmpty():
        more = bases.join(frontier.select(F.col("class_id").alias("base_id"), "family"), "base_id").select("class_id", "family").distinct()
        frontier = cut(more.join(known, ["class_id", "family"], "left_anti"))
        known = cut(known.union(frontier).coalesce(parts))
    return known.groupBy("class_id").agg(F.count("*").alias("n"), F.min("family").alias("family")).where("n = 1").select("class_id", "family")


SYMBOL_DIFF = "path string, old_path string, kind string, qualname string, change string, code string, side string, line int"
#: Bytes of a source that is read.
SOURCE_BYTES = 2_000_000


def diff_symbols(text: str, base: dict[str, bytes], head: dict[str, bytes], most: int = SOURCE_BYTES) -> list[dict]:
    """Changes and gaps of a patch between two versions of its files. A renamed file's symbols are paired over both names;
    a symbol that moved to another file or name is one removed and one added."""
    from sparkloom.sources import diff

    try:
        files = diff.parse(text)
    except diff.DiffError as e:
        return [{"code": "SOURCE_PARSE_ERROR", "qualname": str(e)}]
    out: list[dict] = []
    for f in files:
        path = f.new or f.old
        gap = lambda code, **more: out.append({"path": path, "old_path": f.old, "code": code, **more})  # noqa: B023, E731
        sides = [(name, p, have.get(p)) for name, p, have in (("base", f.old, base), ("head", f.new, head)) if p is not None]
        whole = "BINARY_FILE" if f.binary else "NON_SOURCE_ENTRY" if f.symlink or f.submodule else "COPY_UNSUPPORTED" if f.status == "COPIED" else None
        if whole is None and any(not p.endswith(".py") for _, p, _ in sides):
            whole = "UNSUPPORTED_FILE_TYPE"
        if whole:
            gap(whole)
            continue
        wrong = [(name, "MISSING_SOURCE" if raw is None else "SOURCE_BUDGET_EXCEEDED") for name, _, raw in sides if raw is None or len(raw) > most]
        for name, code in wrong:
            gap(code, side=name)
        if wrong:
            continue
        known = _inventories(sides, gap)
        if known is None:
            continue
        texts = {name: bytes(raw).decode("utf-8-sig") for name, _, raw in sides}
        if not diff.applies(f, texts.get("base", ""), texts.get("head", "")):
            gap("PATCH_SOURCE_MISMATCH")
            continue
        touched: set[tuple[str, str]] = set()
        for name, symbols in known.items():
            lines = [b if name == "head" else a for kind, a, b, _, _ in f.lines if kind == ("+" if name == "head" else "-")]
            for line in lines:
                around = sorted((s["end_line"] - s["start_line"], s["kind"], s["qualname"]) for s in symbols if s["start_line"] <= line <= s["end_line"])
                if not around:
                    gap("MODULE_LEVEL_CHANGE", side=name, line=line)
                elif len(around) > 1 and around[0][0] == around[1][0]:
                    gap("AMBIGUOUS_LINE_OWNER", side=name, line=line)
                else:
                    touched.add(around[0][1:])
        for kind, qualname in sorted(touched):
            before, after = ([s for s in known.get(name, []) if (s["kind"], s["qualname"]) == (kind, qualname)] for name in ("base", "head"))
            if len(before) > 1 or len(after) > 1:
                gap("AMBIGUOUS_SYMBOL_IDENTITY", kind=kind, qualname=qualname)
            elif change := _change(before, after):
                out.append({"path": path, "old_path": f.old, "kind": kind, "qualname": qualname, "change": change})
    return out


def _inventories(sides, gap) -> dict[str, list[dict]] | None:
    """Symbols of each side; None, with gaps, if a side can't be read."""
    from sparkloom.sources import pysource

    out = {}
    for name, _, raw in sides:
        try:
            tree = pysource.read(bytes(raw))
        except (pysource.SourceError, RecursionError):
            gap("SOURCE_PARSE_ERROR", side=name)
            continue
        try:
            out[name] = pysource.symbols(tree, bytes(raw))
        except (ValueError, RecursionError):
            gap("INVALID_SYMBOL_INVENTORY", side=name)
    return out if len(out) == len(sides) else None


def _change(before: list[dict], after: list[dict]) -> str | None:
    if not before or not after:
        return "ADDED" if after else "REMOVED"
    if before[0]["header_digest"] != after[0]["header_digest"]:
        return "SIGNATURE_CHANGED"
    return "BODY_CHANGED" if before[0]["content_digest"] != after[0]["content_digest"] else None


def symbol_diff(patches: DataFrame, base: DataFrame, head: DataFrame, key: str = "patch") -> DataFrame:
    """Changes and gaps (diff_symbols) of each patch. patches: key, text. base, head: key, path, content of the files a patch names.

    A patch and its files are one row of work; files that no patch names aren't read.
    """
    import pandas as pd

    held = lambda df, name: df.groupBy(F.col(key).alias(name)).agg(F.collect_list(F.struct("path", "content")).alias(f"{name}_files"))
    rows = patches.select(key, "text").join(held(base, "_b"), F.col(key) == F.col("_b"), "left").join(held(head, "_h"), F.col(key) == F.col("_h"), "left").select(key, "text", "_b_files", "_h_files")
    names = [c.split(" ")[0] for c in SYMBOL_DIFF.split(", ")]
    files = lambda x: {} if x is None else {f["path"]: bytes(f["content"]) for f in x}

    def run(batches):
        for b in batches:
            out = [{key: k, **r} for k, t, x, y in zip(*(b[c] for c in b.columns)) for r in diff_symbols(t, files(x), files(y))]
            frame = pd.DataFrame(out, columns=[key, *names]).astype(object)
            yield frame.where(frame.notna(), None)

    return rows.mapInPandas(run, f"{key} {patches.schema[key].dataType.simpleString()}, {SYMBOL_DIFF}")

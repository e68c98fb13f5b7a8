"""From facts of source files to symbols and edges, as joins.

Every way a name can be resolved is a join that yields candidates with a rank; where several files or symbols fit, a
candidate only counts if it is the only one of its rank. The least rank wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scoring import stable_id
from brindle.workspace import Workspace

FILE = "$file"
#: Languages in which a file's own directory is searched for names.
SAME_DIR = ("Go", "Java", "C", "Cpp", "CSharp")


def symbols(facts: DataFrame) -> DataFrame:
    """(path, language, module, key, disambiguator, kind, owner, leaf, qualified_name, identity_id, span...) of each symbol.

    Symbols of one key in one file are told apart: of functions the last is plain and the others fn:i; classes beside
    functions are class, class:i; of classes alone the first is plain.
    """
    s = facts.filter("fact = 'symbol'").select("path", "language", "module", "owner", F.col("name").alias("key"), "kind", "start_line", "start_col", "end_line", "end_col", "ord")
    same = Window.partitionBy("path", "key")
    by_kind = Window.partitionBy("path", "key", "kind").orderBy("ord")
    s = s.withColumn("i", F.row_number().over(by_kind) - 1).withColumn("of_kind", F.count(F.lit(1)).over(Window.partitionBy("path", "key", "kind"))).withColumn("n", F.count(F.lit(1)).over(same)).withColumn("fns", F.count_if(F.col("kind") == "Function").over(same))
    i = F.col("i").cast("string")
    cls = F.when(F.col("fns") > 0, F.when(F.col("i") == 0, "class").otherwise(F.concat(F.lit("class:"), i))).otherwise(F.when(F.col("i") == 0, "").otherwise(F.concat(F.lit("class:"), i)))
    d = F.when((F.col("n") == 1) | (F.col("key") == FILE), "").when(F.col("kind") == "Function", F.when(F.col("i") == F.col("of_kind") - 1, "").otherwise(F.concat(F.lit("fn:"), i))).when(F.col("kind") == "Class", cls).otherwise(F.concat(F.lit("other:"), i))
    s = s.withColumn("disambiguator", d)
    qn = F.when(F.col("key") == FILE, F.col("path")).otherwise(F.concat("path", F.lit("::"), "key"))
    identity = stable_id("path", "key", "disambiguator")
    return s.select("path", "language", "module", "key", "disambiguator", "kind", "owner", F.substring_index("key", ".", -1).alias("leaf"), qn.alias("qualified_name"), identity.alias("identity_id"), "start_line", "start_col", "end_line", "end_col", "ord")


def _unique(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups with one distinct value, and that."""
    return df.groupBy(*by).agg(F.min(value).alias(value), F.max(value).alias("__m")).filter(F.col(value) == F.col("__m")).drop("__m")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolved_imports(facts: DataFrame) -> DataFrame:
    """(path, local, kind, remote, to_path) of imports whose module is exactly one file of the batch.

    Tried in order: the module as it is; relative to the file's directory; with the parent's name; any file whose module
    ends with it; an included file's name. A file never imports itself.
    """
    files = facts.filter(F.col("name") == FILE).select(F.col("path").alias("to_path"), F.col("language").alias("to_language"), "module").distinct()
    imp = facts.filter("fact = 'import'").select("path", "language", F.col("name").alias("local"), "kind", F.col("object").alias("want"), "remote", "ord")
    here = directory(F.col("path"))
    dots = F.length(F.regexp_extract("want", r"^(\.*)", 1))
    rest = F.regexp_replace("want", r"^\.+", "")
    # Python's leading dots count packages upward; other languages have ./ and ../ paths.
    up = F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    python = F.when(dots > 0, F.array_join(F.filter(F.array_append(up, F.when(rest == "", None).otherwise(rest)), lambda x: x.isNotNull() & (x != "")), ".")).otherwise(F.col("want"))
    python_name = F.when((dots > 0) | (F.col("kind") == "name"), F.concat(python, F.lit("."), F.coalesce("remote", F.lit(""))))
    joined = F.concat(here, F.lit("/"), F.regexp_replace("want", r"^\./", ""))
    collapsed = reduce(lambda c, _: F.regexp_replace(c, r"[^/]+/\.\./", ""), range(4), joined)
    path_key = F.translate(F.regexp_replace(F.regexp_replace(F.ltrim(F.when(F.col("want").startswith("."), collapsed).otherwise(F.col("want")), F.lit("/")), r"\.(js|jsx|ts|tsx|mjs|cjs|h|hh|hpp|hxx)$", ""), r"/index$", ""), "/", ".")
    colons = F.regexp_replace(F.regexp_replace(F.replace("want", F.lit("::"), F.lit(".")), r"^(crate|self|super)\.", ""), r"^(crate|self|super)$", "")
    include = F.translate(F.regexp_replace(joined, r"\.\w+$", ""), "/", ".")
    keys = F.when(F.col("language") == "Python", F.array(python_name, python)).when(F.col("language").isin("C", "Cpp"), F.array(include, path_key)).when(F.col("language") == "Rust", F.array(colons, F.concat(F.translate(here, "/", "."), F.lit("."), colons), F.concat(colons, F.lit("."), F.coalesce("remote", F.lit(""))))).otherwise(F.array(path_key, F.col("want")))
    tried = imp.select("*", F.posexplode(keys).alias("rank", "key")).filter("key IS NOT NULL AND key != ''")
    family = F.when(F.col("to_language").isin("TypeScript", "JavaScript"), "js").when(F.col("to_language").isin("C", "Cpp"), "c").otherwise(F.col("to_language")).alias("family")
    mine = F.when(F.col("language").isin("TypeScript", "JavaScript"), "js").when(F.col("language").isin("C", "Cpp"), "c").otherwise(F.col("language"))
    tried = tried.withColumn("family", mine)
    exact = _unique(files.select("module", family, "to_path").distinct(), ["module", "family"], "to_path")
    one = tried.join(exact.withColumnRenamed("module", "key"), ["key", "family"])
    # Go's packages have many files: the first by name stands for the package.
    go = files.filter("to_language = 'Go'").groupBy("module").agg(F.min("to_path").alias("to_path"))
    parts = F.split("module", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    suffix = _unique(files.filter(F.size(parts) > 1).select(F.explode(tails).alias("key"), family, "to_path").filter("key != ''"), ["key", "family"], "to_path")
    two = tried.join(suffix, ["key", "family"]).withColumn("rank", F.col("rank") + 10)
    want = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(want)), lambda k: F.array_join(F.slice(want, k, F.size(want)), "."))
    wanted = tried.filter("language = 'Go' AND rank = 0").select("path", "local", "kind", "remote", "ord", "language", F.posexplode(ends).alias("rank", "key"))
    three = wanted.join(go.withColumnRenamed("module", "key"), "key").withColumn("rank", F.col("rank") + 20)
    cols = ["path", "local", "kind", "remote", "ord", "rank", "key", "to_path", "language"]
    cand = one.select(*cols).unionByName(two.select(*cols)).unionByName(three.select(*cols)).filter("to_path != path")
    best = cand.groupBy("path", "ord").agg(F.min(F.struct("rank", "to_path", "local", "kind", "remote", "key", "language")).alias("b")).select("path", "ord", "b.*")
    # from package import module: the name is the file itself.
    whole = F.col("language").isin("Python", "Rust") & (F.col("kind") == "name") & F.col("key").endswith(F.concat(F.lit("."), "remote"))
    return best.select("path", "ord", "local", F.when(whole, "module").otherwise(F.col("kind")).alias("kind"), "remote", "to_path")


#: The longest chain of fields that is followed from a receiver.
CHAIN = 4


def _typed_receivers(attr: DataFrame, types: DataFrame, syms: DataFrame, names: DataFrame, cls: Column) -> DataFrame:
    """attr with (at, type): the type of each call's receiver, as it is named in the file ``at``.

    A receiver is a variable of the function or the instance itself, and fields from there on: each step looks for the
    class of the type so far, here or where it is imported from, and takes the field's type from it. Of several types that
    a variable is given the first counts; a chain longer than ``CHAIN`` or with a field of no known type has none.
    """
    local_types, field_types = (types.filter(F.col("what") == k).drop("what") for k in ("local", "field"))
    parts = F.split("object", r"\.")
    c = attr.withColumn("parts", parts)
    self_ = F.col("parts")[0].isin("self", "this")
    start = c.filter(~self_).withColumn("var", F.col("parts")[0]).join(local_types, ["path", "owner", "var"]).drop("var")
    start = start.unionByName(c.filter(self_ & (F.size("parts") > 1)).withColumn("type", cls)).withColumn("at", F.col("path")).withColumn("rest", F.slice("parts", F.lit(2), F.size("parts"))).drop("parts")
    classes = syms.filter("kind = 'Class'").select(F.col("path").alias("in_file"), F.col("key").alias("in_class")).distinct()
    fields = field_types.select(F.col("path").alias("in_file"), F.col("owner").alias("in_class"), "var", F.col("type").alias("next"))
    away = names.select(F.col("path").alias("at"), F.col("local").alias("type"), "remote", "file").dropDuplicates(["at", "type"])
    done, now = start.filter(F.size("rest") == 0), start.filter(F.size("rest") > 0)
    for _ in range(CHAIN):
        # The class so far: of this file, else an imported one.
        here = now.join(classes.withColumnRenamed("in_file", "at").withColumnRenamed("in_class", "type").withColumn("here", F.lit(True)), ["at", "type"], "left").join(away, ["at", "type"], "left")
        where = here.withColumn("in_file", F.when(F.col("here"), F.col("at")).otherwise(F.col("file"))).withColumn("in_class", F.when(F.col("here"), F.col("type")).otherwise(F.col("remote"))).drop("here", "remote", "file")
        step = where.withColumn("var", F.col("rest")[0]).join(fields, ["in_file", "in_class", "var"])
        step = step.withColumn("at", F.col("in_file")).withColumn("type", F.col("next")).withColumn("rest", F.slice("rest", F.lit(2), F.size("rest"))).select(*start.columns)
        done, now = done.unionByName(step.filter(F.size("rest") == 0)), step.filter(F.size("rest") > 0)
    return done.drop("rest")


def resolved_calls(facts: DataFrame, syms: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, ord, owner, to_path, to_key, rank): each call with the symbol it resolves to; others have no row."""
    calls = facts.filter("fact = 'call'").select("path", "language", "owner", "name", "object", "ord", directory(F.col("path")).alias("dir"))
    # Functions before classes, plain before told apart: one row for each key of a file.
    pref = F.struct((F.col("kind") != "Function").cast("int"), (F.col("disambiguator") != "").cast("int"), "ord")
    table = syms.filter(F.col("key") != FILE).groupBy("path", "key").agg(F.min_by(F.struct("leaf", "owner", "kind", "language"), pref).alias("b")).select("path", "key", "b.*")
    to = table.select(F.col("path").alias("to_path"), F.col("key").alias("to_key"))
    cls = F.regexp_extract("owner", r"^(.*)\.[^.]+$", 1)
    root, own = F.substring_index("object", ".", 1), F.col("object").isin("self", "this", "cls", "Self")
    bare, attr = calls.filter("object IS NULL"), calls.filter("object IS NOT NULL")
    cols = ["path", "ord", "owner", "to_path", "to_key"]
    found: list[DataFrame] = []

    def add(df: DataFrame, rank: int, unique: bool = False) -> None:
        df = df.filter((F.col("to_path") != F.col("path")) | (F.col("to_key") != F.col("owner")) | F.lit(rank < 20)).select(*cols)
        if unique:
            df = df.groupBy("path", "ord", "owner").agg(F.min(F.struct("to_path", "to_key")).alias("a"), F.max(F.struct("to_path", "to_key")).alias("b")).filter("a = b").select("path", "ord", "owner", "a.to_path", "a.to_key")
        found.append(df.withColumn("rank", F.lit(rank)))

    # The same file: the plain name, then a method of the enclosing class.
    add(bare.join(to, (F.col("to_path") == F.col("path")) & (F.col("to_key") == F.col("name"))), 10)
    add(bare.filter("language != 'Rust'").withColumn("k", F.concat(cls, F.lit("."), "name")).join(to, (F.col("to_path") == F.col("path")) & (F.col("to_key") == F.col("k"))), 11)
    add(attr.withColumn("k", F.when(own, F.concat(cls, F.lit("."), "name")).otherwise(F.concat("object", F.lit("."), "name"))).join(to, (F.col("to_path") == F.col("path")) & (F.col("to_key") == F.col("k"))), 12)
    names = imports.filter("kind = 'name'").select("path", "local", "remote", F.col("to_path").alias("file"))
    mods = imports.filter("kind = 'module'").select("path", "local", F.col("to_path").alias("file"))
    stars = imports.filter("kind = 'star'").select("path", F.col("to_path").alias("file")).distinct()
    # Bare names: the imported one, one of an import of everything, the only one in the directory.
    add(bare.join(names, ["path"]).filter("name = local").join(to, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("remote"))), 20)
    add(bare.join(stars, "path").join(to, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("name"))), 21, True)
    near = table.filter(F.col("kind") == "Function").select(directory(F.col("path")).alias("dir"), F.col("leaf").alias("name"), F.col("path").alias("to_path"), F.col("key").alias("to_key"), F.col("language").alias("l2"))
    add(bare.filter(F.col("language").isin(*SAME_DIR)).join(near.filter("to_key = name"), ["dir", "name"]).filter("language = l2"), 22, True)
    # The type of a receiver: a variable of the function, or a field of its class; the type here or imported.
    types = facts.filter("fact = 'type'").groupBy("path", "owner", F.col("name").alias("var"), F.col("kind").alias("what")).agg(F.min_by("object", "ord").alias("type"))
    # Four steps that each read the one before: written once, as it is read twice.
    typed = Workspace(facts.sparkSession, "receivers").write(_typed_receivers(attr, types, syms, names, cls), "typed")
    add(typed.withColumn("k", F.concat("type", F.lit("."), "name")).join(to, (F.col("to_path") == F.col("at")) & (F.col("to_key") == F.col("k"))), 30)
    away = names.select(F.col("path").alias("at"), "local", "remote", "file")
    add(typed.join(away, "at").filter("type = local").withColumn("k", F.concat("remote", F.lit("."), "name")).join(to, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("k"))), 31)
    # The root of the receiver is an import: a member of the module's file, or of the imported class.
    add(attr.withColumn("root", root).join(mods, ["path"]).filter("root = local OR object = local").join(to, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("name"))), 32)
    add(attr.withColumn("root", root).join(names, ["path"]).filter("root = local").withColumn("k", F.concat("remote", F.lit("."), "name")).join(to, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("k"))), 33)
    # The only class of that name in the directory, the only callable, then a leaf of an import of everything.
    add(attr.filter(F.col("language").isin(*SAME_DIR)).withColumn("k", F.concat(root, F.lit("."), "name")).join(near.select("dir", F.col("to_key").alias("k"), "to_path", "to_key", "l2"), ["dir", "k"]).filter("language = l2"), 34, True)
    add(attr.filter(F.col("language").isin(*SAME_DIR)).join(near, ["dir", "name"]).filter("language = l2"), 35, True)
    add(attr.join(stars, "path").join(to, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("name"))), 36, True)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("path", "ord", "owner").agg(F.min(F.struct("rank", "to_path", "to_key")).alias("b")).select("path", "ord", "owner", "b.to_path", "b.to_key", "b.rank")


def _types_named(facts: DataFrame, fact: str, syms: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, ord, owner, to_path, to_key) of uses or base types that name a class here or an imported one."""
    f = facts.filter(F.col("fact") == fact).select("path", "ord", "owner", F.substring_index("name", ".", -1).alias("want"))
    classes = syms.filter("kind = 'Class'").select(F.col("path").alias("to_path"), F.col("key").alias("to_key")).distinct()
    here = f.join(classes, (F.col("to_path") == F.col("path")) & (F.col("to_key") == F.col("want"))).withColumn("rank", F.lit(0))
    names = imports.filter("kind = 'name'").select("path", F.col("local").alias("want"), "remote", F.col("to_path").alias("file"))
    there = f.join(names, ["path", "want"]).join(classes, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("remote"))).withColumn("rank", F.lit(1))
    stars = imports.filter("kind = 'star'").select("path", F.col("to_path").alias("file")).distinct()
    wide = f.join(stars, "path").join(classes, (F.col("to_path") == F.col("file")) & (F.col("to_key") == F.col("want"))).withColumn("rank", F.lit(2))
    cols = ["path", "ord", "owner", "to_path", "to_key", "rank"]
    every = reduce(DataFrame.unionByName, [x.select(*cols) for x in (here, there, wide)])
    return every.groupBy("path", "ord", "owner").agg(F.min(F.struct("rank", "to_path", "to_key")).alias("b")).select("path", "ord", "owner", "b.to_path", "b.to_key")


def edges(facts: DataFrame, syms: DataFrame | None = None) -> DataFrame:
    """(edge_id, ty, source_id, target_id, source_path, source_key, target_path, target_key), each once.

    Imports start at the file's own symbol and lead to the imported symbol, or to the other file's symbol for whole modules
    and imports of everything; Calls and Uses start at their function, or at the file's symbol; Extends at the class.
    """
    ws = Workspace(facts.sparkSession, "edges")
    syms = ws.write(symbols(facts) if syms is None else syms, "symbols")
    imports = ws.write(resolved_imports(facts), "imports")
    known = syms.select(F.col("path").alias("target_path"), F.col("key").alias("target_key"), "identity_id", "disambiguator", "ord")
    ids = known.groupBy("target_path", "target_key").agg(F.min_by("identity_id", F.struct((F.col("disambiguator") != "").cast("int"), "ord")).alias("target_id"))
    named = imports.select("path", "ord", F.lit(FILE).alias("owner"), "to_path", F.when(F.col("kind") == "name", F.col("remote")).otherwise(FILE).alias("to_key")).withColumn("ty", F.lit("Imports"))
    parts = [
        named,
        resolved_calls(facts, syms, imports).drop("rank").withColumn("ty", F.lit("Calls")),
        _types_named(facts, "extends", syms, imports).withColumn("ty", F.lit("Extends")),
        _types_named(facts, "use", syms, imports).withColumn("ty", F.lit("Uses")),
    ]
    cols = ["ty", "path", "owner", "to_path", "to_key"]
    e = reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])
    e = e.select("ty", F.col("path").alias("source_path"), F.when(F.col("owner") == "", FILE).otherwise(F.col("owner")).alias("source_key"), F.col("to_path").alias("target_path"), F.col("to_key").alias("target_key")).distinct()
    e = e.filter("NOT (source_path = target_path AND source_key = target_key AND ty = 'Imports')")
    src = ids.select(F.col("target_path").alias("source_path"), F.col("target_key").alias("source_key"), F.col("target_id").alias("source_id"))
    e = e.join(ids, ["target_path", "target_key"]).join(src, ["source_path", "source_key"])
    return e.select(stable_id("source_id", "ty", "target_id").alias("edge_id"), "ty", "source_id", "target_id", "source_path", "source_key", "target_path", "target_key")


def next_revisions(syms: DataFrame, bodies: DataFrame, primaries: DataFrame, branch_id: int) -> DataFrame:
    """(identity_id, revision_id, parent_revision_id, body_hash, action) of parsed symbols against the branch's primaries.

    bodies: identity_id, body_hash of the new parse; primaries: identity_id, revision_id, body_hash, file_path. Without a
    primary a symbol is new; with the same body its revision is reused; a changed body retires it and links to it. A
    primary of a parsed file whose symbol is gone is retired.
    """
    new = syms.join(bodies, "identity_id", "left").select("identity_id", "body_hash", "path")
    old = primaries.select("identity_id", F.col("revision_id").alias("old_rev"), F.col("body_hash").alias("old_body"), "file_path")
    touched = syms.select(F.col("path").alias("file_path")).distinct()
    j = new.join(old, "identity_id", "full").join(touched.withColumn("touched", F.lit(True)), "file_path", "left")
    action = F.when(F.col("path").isNull(), F.when(F.col("touched"), "retire")).when(F.col("old_rev").isNull(), "new").when(F.col("old_body").eqNullSafe(F.col("body_hash")), "reuse").otherwise("change")
    fresh = stable_id(F.lit(str(branch_id)), "identity_id", F.coalesce("body_hash", F.lit("")))
    rev = F.when(action == "reuse", F.col("old_rev")).when(action.isin("new", "change"), fresh).otherwise(F.col("old_rev"))
    return j.withColumn("action", action).filter("action IS NOT NULL").select("identity_id", rev.alias("revision_id"), F.when(F.col("action") == "change", F.col("old_rev")).alias("parent_revision_id"), "body_hash", "action")

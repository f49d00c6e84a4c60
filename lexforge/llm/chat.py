"""Tool-call linking with DataFrame operations only.

Messages are rows (conv_id, turn, role, text). A call is an entry of `tool_calls` (id, name, arguments, depends: ids it needs) in an assistant
message that is a JSON object, a result is a `tool` message with JSON `tool_call_id` and `content`. In plain talk each user turn is taken for
a call of the tool `reply`, named by its turn, and the assistant turn after it for its result. Stated and implied calls have names of their own (`kind`),
so that a stated id that looks like a turn doesn't meet an implied one.

JSON is read as variants: values keep their JSON types, and objects come out with sorted keys and without spaces at every depth. Calls
and results meet in a hash join on (conv_id, kind, id). Each conversation's calls are put in topological order: a call's level is its turn
where every dependency of its conversation points to an earlier turn, which one join tests; elsewhere stated calls get levels in rounds that place the
calls all of whose dependencies are placed. `position` numbers the calls by (level, turn, kind, id), by counts of blocks of levels, so that no
conversation is numbered in one task. Calls on a cycle, or after one, get no position. Arguments are checked against the
tool's schema (unknown, missing, type, longest), and each record is serialised as canonical JSON.

Defined cases: rows with a null conv_id or turn are no messages of any conversation and are left out; null text is the empty
text; repeated rows count once. Every call and result is linked by its identifier, also where several stand at one turn; of calls with one
identifier the one of smallest (turn, JSON) counts, of implied ones of smallest text, of results that of smallest (turn, text). A call
without result has status `unanswered`, an unknown tool or bad arguments `invalid`. Arguments may be an object or a text that holds one;
anything else is `type:arguments`, none at all is the empty object. Content that isn't a text is its canonical JSON. Text that can't be parsed, or that
repeats a key, is plain talk; calls without id or that aren't objects are left out; dependencies that name no call of the conversation are ignored. Empty
table: empty result. Other columns don't matter. No step needs a conversation's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Schemas of tools: argument -> (type, required, longest text or None).
TOOLS: dict[str, dict[str, tuple[str, bool, int | None]]] = {"reply": {"prompt": ("string", True, 400), "turn": ("integer", True, None)}}
#: How values of a JSON type are named when read as variants.
SHAPES = {"integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "string": "^STRING$", "object": "^OBJECT", "array": "^ARRAY"}
#: Levels that are numbered together.
BLOCK = 1024


def quoted(text: Column) -> Column:
    """A JSON string."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def got(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def messages(table: DataFrame) -> DataFrame:
    m = table.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    return m.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())


def parsed(m: DataFrame, role: str) -> DataFrame:
    return m.where((F.col("role") == role) & F.ltrim("text").startswith("{")).select("conv_id", "turn", F.try_parse_json("text").alias("j"))


def calls_and_results(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, kind, id, turn, name, arguments, depends) and (conv_id, kind, id, result_turn, result): one row an identifier each."""
    m = messages(table)
    stated = parsed(m, "assistant").select("conv_id", "turn", F.explode(got("j", "$.tool_calls", "array<variant>")).alias("c"))
    stated = stated.select("conv_id", "turn", got("c", "$.id", "string").alias("id"), F.to_json("c").alias("call")).where(F.col("id").isNotNull())
    stated = stated.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "call")).alias("x")).select("conv_id", "id", "x.turn", F.parse_json("x.call").alias("c"))
    given = F.when(F.schema_of_variant(got("c", "$.arguments", "variant")) == "STRING", F.try_parse_json(got("c", "$.arguments", "string"))).otherwise(got("c", "$.arguments", "variant"))
    stated = stated.select("conv_id", F.lit("stated").alias("kind"), "id", "turn", got("c", "$.name", "string").alias("name"), given.alias("arguments"), got("c", "$.depends", "array<string>").alias("depends"), got("c", "$.arguments", "variant").isNull().alias("bare"))
    stated = stated.withColumn("arguments", F.when(F.col("bare"), F.parse_json(F.lit("{}"))).otherwise(F.col("arguments"))).drop("bare")

    implied = m.where(F.col("role") == "user").groupBy("conv_id", "turn").agg(F.min("text").alias("prompt"))
    implied = implied.select(
        "conv_id",
        F.lit("implied").alias("kind"),
        F.col("turn").cast("string").alias("id"),
        "turn",
        F.lit("reply").alias("name"),
        F.parse_json(F.to_json(F.struct("prompt", "turn"))).alias("arguments"),
        F.lit(None).cast("array<string>").alias("depends"),
    )
    answers = parsed(m, "tool").select("conv_id", F.lit("stated").alias("kind"), got("j", "$.tool_call_id", "string").alias("id"), F.col("turn").alias("result_turn"), got("j", "$.content", "string").alias("result"))
    plain = m.where(F.col("role") == "assistant").select("conv_id", F.lit("implied").alias("kind"), (F.col("turn") - 1).cast("string").alias("id"), F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    results = answers.where(F.col("id").isNotNull()).unionByName(plain).groupBy("conv_id", "kind", "id").agg(F.min(F.struct("result_turn", "result")).alias("r")).select("conv_id", "kind", "id", "r.result_turn", "r.result")
    return stated.unionByName(implied), results


def problems(tools: dict = TOOLS) -> Column:
    """What is wrong with `args` (the arguments as a map of variants, null if they are none) under the schema of `name`: sorted texts, empty if all is well."""
    out = F.array(F.concat(F.lit("tool:"), F.coalesce("name", F.lit(""))))
    for tool, schema in tools.items():
        found = [F.transform(F.filter(F.map_keys("args"), lambda k: ~k.isin(*schema)), lambda k: F.concat(F.lit("unknown:"), k))]  # noqa: B023
        for arg, (kind, required, longest) in schema.items():
            v = F.col("args")[arg]
            if required:
                found.append(F.when(v.isNull(), F.array(F.lit(f"missing:{arg}"))).otherwise(F.array()))
            found.append(F.when(v.isNotNull() & ~F.schema_of_variant(v).rlike(SHAPES[kind]), F.array(F.lit(f"type:{arg}"))).otherwise(F.array()))
            if longest is not None:
                found.append(F.when(F.length(F.try_variant_get(v, "$", "string")) > longest, F.array(F.lit(f"long:{arg}"))).otherwise(F.array()))
        out = F.when(F.col("name") == tool, F.when(F.col("args").isNull(), F.array(F.lit("type:arguments"))).otherwise(F.array_sort(F.concat(*found)))).otherwise(out)
    return out


def canonical() -> Column:
    """The record as JSON: sorted keys at every depth, no spaces, values of the types they were given with."""
    null = F.lit("null")
    parts = [F.lit('{"arguments":'), F.coalesce(F.to_json("arguments"), null), F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), null), F.lit(',"result":'), F.coalesce(quoted(F.col("result")), null), F.lit("}")]
    return F.concat(*parts)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, kind, id, turn, level; the level is null on a cycle or after one."""
    own = calls.select("conv_id", "kind", "id", "turn")
    need = calls.where(F.col("kind") == "stated").select("conv_id", "id", "turn", F.explode("depends").alias("dep"))
    need = need.join(own.where(F.col("kind") == "stated").select("conv_id", F.col("id").alias("dep"), F.col("turn").alias("dep_turn")), ["conv_id", "dep"])
    tables = Tables(calls.sparkSession)
    need = tables.save(need, "need")
    astray = tables.save(need.where(F.col("dep_turn") >= F.col("turn")).select("conv_id").distinct().withColumn("kind", F.lit("stated")), "astray")
    straight = own.withColumn("level", F.col("turn"))
    if astray.isEmpty():
        return straight
    left = tables.save(own.join(astray, ["conv_id", "kind"]).select("conv_id", "id", "turn"), "left")
    edges = tables.save(need.join(astray, "conv_id", "left_semi").select("conv_id", "id", "dep").distinct(), "edges")
    placed, level = None, 0
    while True:
        open_ = edges.join(left.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"], "left_semi")
        now = tables.save(left.join(open_.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level).cast("long")), "placed")
        if now.isEmpty():
            break
        placed = now if placed is None else placed.union(now)
        # what waits, and its edges, shrink with every round
        rest, waiting = tables.save(left.join(now, ["conv_id", "id"], "left_anti"), "left"), tables.save(open_, "edges")
        tables.drop(left, edges)
        left, edges, level = rest, waiting, level + 1
    stuck = left.withColumn("level", F.lit(None).cast("long"))
    ordered = (stuck if placed is None else placed.union(stuck)).select("conv_id", F.lit("stated").alias("kind"), "id", "turn", "level")
    return straight.join(astray, ["conv_id", "kind"], "left_anti").unionByName(ordered)


def positions(calls: DataFrame) -> DataFrame:
    """conv_id, kind, id, position: the place in the conversation's topological order, from 0."""
    at = levels(calls).withColumn("block", F.floor(F.col("level") / BLOCK))
    counts = at.where(F.col("level").isNotNull()).groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("level", "turn", "kind", "id")) - 1
    numbered = at.withColumn("place", place).join(counts, ["conv_id", "block"], "left")
    return numbered.select("conv_id", "kind", "id", (F.col("place") + F.col("before")).cast("long").alias("position"))


def link(table: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """conv_id, call_id, kind, turn, position, result_turn, name, status, problems, record: one row for each call."""
    calls, results = calls_and_results(table)
    name = ["conv_id", "kind", "id"]
    linked = calls.drop("depends").join(results.hint("shuffle_hash"), name, "left").join(positions(calls).hint("shuffle_hash"), name)
    linked = linked.withColumn("args", got("arguments", "$", "map<string,variant>")).withColumn("problems", problems(tools))
    status = F.when(F.size("problems") > 0, "invalid").when(F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    return linked.select("conv_id", F.col("id").alias("call_id"), "kind", "turn", "position", "result_turn", "name", status.alias("status"), F.array_join("problems", ",").alias("problems"), canonical().alias("record"))

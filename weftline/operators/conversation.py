"""Conversation windows, tool calls, plans, hand-offs and state graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import n_tokens
from ..sources.shared import keep

#: Models that requests are routed to.
MOST_MODELS = 100_000
#: Rounds of a graph walk after which what they have found is written as one table.
MERGE_ROUNDS = 10


def last_n(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation by turn; system messages stay besides."""
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    talk = messages.where("role != 'system'").withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n).drop("_r")
    return messages.where("role = 'system'").unionByName(talk)


def truncate_tokens(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages that fit whole into the budget of tokens, up to the first that doesn't; system messages stay and count first."""
    size = n_tokens(F.col("text"))
    system = F.sum(F.when(F.col("role") == "system", size).otherwise(0)).over(Window.partitionBy("conv_id"))
    back = F.sum(F.when(F.col("role") != "system", size).otherwise(0)).over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0))
    own = messages.select(F.struct("*").alias("_row"), "conv_id", "turn", "role", "text")  # no name of the table's is overwritten
    counted = own.withColumns({"_system": system, "_back": back})
    return counted.where((F.col("role") == "system") | (F.col("_system") + F.col("_back") <= budget)).select("_row.*")


def context(messages: DataFrame) -> DataFrame:
    """conv_id, context, n_turns: the turns as lines "role: text"."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("context"), F.count("*").alias("n_turns"))


def hybrid_memory(messages: DataFrame, recalled: DataFrame, n: int) -> DataFrame:
    """The last n messages and the recalled ones (conv_id, turn) of the same conversation, each once."""
    recent = last_n(messages, n).select("conv_id", "turn")
    wanted = recent.union(recalled.select("conv_id", "turn")).distinct()
    return messages.join(wanted, ["conv_id", "turn"], "left_semi")


def parse_actions(steps: DataFrame, column: str = "output") -> DataFrame:
    """steps with thought, action and argument of outputs "Thought: ... Action: name[argument]"; null where they aren't found."""
    part = lambda p, i: F.nullif(F.regexp_extract(column, p, i), F.lit(""))
    act = r"Action:\s*(\w+)\[([^\]]*)\]"
    return steps.withColumns({"thought": part(r"Thought:\s*(.*?)\s*(?:Action:|$)", 1), "action": part(act, 1), "argument": part(act, 2)})


def check_calls(calls: DataFrame, registry: DataFrame, arguments: str = "args", schema: str = "k int") -> DataFrame:
    """calls with status: 'unknown_tool', 'bad_arguments' (not JSON of the schema, or a null in it) or 'ok'; the registry has a column tool."""
    known = registry.select("tool", F.lit(True).alias("_known")).distinct()
    parsed = F.from_json(arguments, schema)
    names = [f.split()[0] for f in schema.split(",")]
    bad = parsed.isNull() | ~F.coalesce(*[F.forall(F.array(*(parsed[n].isNotNull() for n in names)), lambda x: x)])
    return calls.join(known, "tool", "left").withColumn("status", F.when(F.col("_known").isNull(), "unknown_tool").when(bad, "bad_arguments").otherwise("ok")).drop("_known")


def describe_tools(registry: DataFrame) -> DataFrame:
    """kind, listing: one text per kind with a line for each name and description."""
    items = F.array_sort(F.collect_list(F.struct("name", "description")))
    return registry.groupBy("kind").agg(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["description"])), "\n").alias("listing"))


def failures(steps: DataFrame) -> DataFrame:
    """Failed steps (ok false) with the step that follows in the run and whether it repeats the action."""
    by = Window.partitionBy("run_id").orderBy("step")
    return steps.withColumns({"next_action": F.lead("action").over(by), "next_ok": F.lead("ok").over(by)}).where("not ok").withColumn("repeated", F.coalesce(F.col("next_action") == F.col("action"), F.lit(False)))


def handoffs(messages: DataFrame, group: str, order: Column | str, role: str) -> DataFrame:
    """from_role, to_role, n of adjacent steps."""
    following = F.lead(role).over(Window.partitionBy(group).orderBy(order))
    return messages.select(F.col(role).alias("from_role"), following.alias("to_role")).where("to_role is not null").groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, depth of the nodes that the starts (node) reach over the edges (src, dst), by breadth-first rounds.

    Each round writes its new nodes and reads them back, and the rounds are
    merged from time to time, so a plan never holds the ones before. There are
    as many rounds as the longest of the shortest paths has edges. Null nodes
    are left out.
    """
    edges = keep(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    front = found = keep(starts.where("node is not null").select("node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = keep(step.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(front)
        if depth % MERGE_ROUNDS == 0:
            found = keep(found)
    return found


def plan_order(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """task, level: 0 without needs (task, needs), else one more than the deepest task that it needs. Tasks in a cycle are absent.

    As in reachable(), rounds are written; each takes away the needs that the
    one before has met.
    """
    open_ = keep(needs.select("task", "needs").distinct().join(tasks.select("task"), "task", "left_semi"))
    waiting = keep(open_.select("task").distinct())
    front = done = keep(tasks.select("task").distinct().join(waiting, "task", "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while not front.isEmpty():
        level += 1
        open_ = keep(open_.join(front.select(F.col("task").alias("needs")), "needs", "left_anti"))
        front = keep(waiting.join(open_.select("task"), "task", "left_anti").withColumn("level", F.lit(level)))
        waiting = keep(waiting.join(front, "task", "left_anti"))
        done = done.unionByName(front)
        if level % MERGE_ROUNDS == 0:
            done = keep(done)
    return done


def last_state(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The newest state of each key."""
    row = F.max_by(F.struct(*columns), order)
    return log.groupBy(key).agg(row.alias("_s")).select(key, *(F.col(f"_s.{c}").alias(c) for c in columns))


def outcomes(attempts: DataFrame) -> DataFrame:
    """call, attempts, final: how often each call (call, attempt, status) was tried and its last status."""
    return attempts.groupBy("call").agg(F.count("*").alias("attempts"), F.max_by("status", "attempt").alias("final"))


def route(requests: DataFrame, models: DataFrame) -> DataFrame:
    """request_id, model, cost: the cheapest available model able to serve each request (needs, tokens); ties by name.

    Models (model, level, window, price, available) are a catalogue of at most
    MOST_MODELS rows, which is checked, as the non-equi join broadcasts them.
    """
    if models.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"over {MOST_MODELS} models")
    able = (models["level"] >= requests["needs"]) & (models["window"] >= requests["tokens"]) & models["available"]
    choice = F.min(F.struct(F.col("price"), F.col("model")))
    return requests.join(F.broadcast(models), able, "left").groupBy("request_id", "tokens").agg(choice.alias("c")).select("request_id", F.col("c.model").alias("model"), F.round(F.col("c.price") * F.col("tokens"), 6).alias("cost"))

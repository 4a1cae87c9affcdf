"""Chat formatting of reply trees.

Messages form trees by their parents. Iterated self-joins find every message's way to its root:
each round joins the table of jumps with itself, so that jumps double and a tree of depth d takes
about log2(d) rounds, whatever its shape. That gives each leaf the length and the score of its
branch (the sum of its messages' scores). Branches are ranked per tree, and only the chosen ones
are spelled out, by the same jumps, and formatted as one conversation each.

Only ids and scores travel until the branches are chosen; texts are joined to the chosen paths
once. Each round is a written table, so a lost executor costs one round. The leaves of a crowded
tree are cut to the best per task before they meet; messages that very many chosen branches share
are dealt out by salt. A conversation itself is one row, so its messages come together.

The template marks turns by control strings; a backslash is put into those that a text holds by
itself, so formatted conversations can be read back exactly. Everything is DataFrame functions.

Defined results: messages without tree or id are in no tree and are left out (:func:`linear` gives
every row both, conversations without an id being one conversation); a parent that is missing,
null or the message itself makes a root; of rows with the same tree and id the least (by parent,
role, text) counts; messages on or behind a cycle of parents have no root and are left out; null
texts and roles are empty, null scores 0; ties of branches are settled by the leaf's id, rows of
one turn by role and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadledger.llm.markers import checked, quoted
from roadledger.session import shared_dir, written

# Messages on more than this many chosen branches are dealt out; at most MAX_SHARED are listed.
ROWS_PER_SALT = 1_000_000
MAX_SHARED = 10_000


@dataclass(frozen=True)
class Template:
    """begin, then per turn open, role, close, text, end."""

    begin: str = "<s>"
    open: str = "[INST]"
    close: str = "[/INST]"
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        checked(*self.tokens)

    @property
    def tokens(self) -> tuple[str, str, str, str]:
        return self.begin, self.open, self.close, self.end

    def _heads(self, slashes: str) -> str:
        """A group for the first character of a control string with such backslashes behind it."""
        each = []
        for head in sorted({token[0] for token in self.tokens}):
            tails = "|".join(quoted(token[1:]) for token in self.tokens if token[0] == head)
            each.append(f"{quoted(head)}(?={slashes}(?:{tails}))")
        return f"({'|'.join(each)})"

    def escaped(self, text: Column) -> Column:
        """One more backslash behind the first character of each (escaped) control string."""
        return F.regexp_replace(text, F.lit(self._heads(r"\\*+")), F.lit(r"$1\\"))

    def unescaped(self, text: Column) -> Column:
        """What :meth:`escaped` was given."""
        return F.regexp_replace(text, F.lit(self._heads(r"\\++") + r"\\"), F.lit("$1"))


def linear(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as reply trees: every turn answers the one before."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    return conversations.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"),
        place.alias("message"),
        F.nullif(place - 1, F.lit(0)).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _at(table: DataFrame) -> DataFrame:
    """The table with names of its own, for a join of messages with messages."""
    return table.select(*(F.col(name).alias(f"at_{name}") for name in table.columns))


def _there(message: str) -> Column:
    """Same tree (null is one, too), and ``message`` names the other side's message."""
    return F.col("tree").eqNullSafe(F.col("at_tree")) & (F.col(message) == F.col("at_message"))


def _distinct(messages: DataFrame) -> DataFrame:
    """One row per tree and message; the least of several."""
    row = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = messages.filter(F.col("message").isNotNull())
    return known.groupBy("tree", "message").agg(F.min(row).alias("row")).select("tree", "message", "row.*")


def _branches(messages: DataFrame, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, message, turns, score) of every message with a root, and the tables of jumps.

    ``turns`` and ``score`` count from the root to the message. Jump table k holds the message
    2**k steps up, where there is one.
    """
    spark = messages.sparkSession
    slim = messages.select("tree", "message", F.when(F.col("parent") != F.col("message"), F.col("parent")).alias("parent"), "score")
    now = slim.join(_at(slim.select("tree", "message")), _there("parent"), "left").select(
        "tree", "message", F.col("at_message").alias("jump"), F.lit(1).cast("bigint").alias("turns"), "score"
    )
    jumps, settled, left = [], [], None
    while True:
        now = written(now, f"{folder}/way-{len(jumps)}")
        ways = now.filter(F.col("jump").isNotNull())
        open_ways = ways.count()
        jumps.append(ways.select("tree", "message", "jump"))
        # Every round settles a message as long as any open one has a root; the rest runs in circles.
        if open_ways == 0 or open_ways == left:
            break
        left, tops = open_ways, now
        for table in settled:
            tops = tops.unionByName(table)
        settled.append(now.filter(F.col("jump").isNull()))
        now = ways.join(_at(tops), _there("jump")).select(
            "tree", "message", F.col("at_jump").alias("jump"), (F.col("turns") + F.col("at_turns")).alias("turns"), (F.col("score") + F.col("at_score")).alias("score")
        )
    known = now.filter(F.col("jump").isNull())
    for table in settled:
        known = known.unionByName(table)
    return known.drop("jump"), jumps


def chosen_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch, branch_score, place, message): the root-to-leaf paths, best first.

    ``branches`` is the number of branches per tree, by score and then by the smaller leaf; None
    takes all. ``place`` counts a path's messages from 1 at the root.
    """
    spark = messages.sparkSession
    folder = shared_dir(spark, "chat-paths")
    known, jumps = _branches(messages, folder)
    answered = jumps[0].select("tree", F.col("jump").alias("message")).distinct()
    leaves = known.join(_at(answered), _there("message"), "left_anti")
    branch = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "message"))
    ranked = leaves.withColumn("branch", branch)
    if branches is not None:
        ranked = ranked.filter(F.col("branch") <= branches)
    paths = ranked.select(
        "tree", F.col("message").alias("leaf"), "branch", F.col("score").alias("branch_score"), F.col("turns").alias("place"), "message"
    )
    for k, jump in enumerate(jumps[:-1]):
        paths = written(paths, f"{folder}/path-{k}")
        up = paths.join(_at(jump), _there("message")).select(
            "tree", "leaf", "branch", "branch_score", (F.col("place") - 2**k).alias("place"), F.col("at_jump").alias("message")
        )
        paths = paths.unionByName(up)
    return paths


def _with_texts(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """Role and text of every place of the paths."""
    paths = written(paths, shared_dir(paths.sparkSession, "chat-places"))
    total = paths.count()
    limit = max(ROWS_PER_SALT, total // MAX_SHARED)
    shared = paths.groupBy("tree", "message").count().filter(F.col("count") > limit)
    shared = shared.select("tree", "message", F.ceil(F.col("count") / limit).alias("salts"))
    if total <= limit or shared.isEmpty():
        joined = paths.join(_at(messages), _there("message"))
    else:
        def dealt(rows: DataFrame) -> DataFrame:
            # At most MAX_SHARED rows, by the limit above.
            known = rows.join(F.broadcast(_at(shared)), _there("message"), "left")
            return known.select(*(rows[name] for name in rows.columns), F.coalesce("at_salts", F.lit(1)).cast("bigint").alias("salts"))

        here = dealt(paths).withColumn("salt", F.pmod(F.xxhash64("leaf"), F.col("salts"))).drop("salts")
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))
        there = dealt(messages).withColumn("salt", salts).drop("salts")
        joined = here.join(_at(there), _there("message") & (F.col("salt") == F.col("at_salt")))
    return joined.select(*paths.columns, F.col("at_role").alias("role"), F.col("at_text").alias("text"))


def formatted(messages: DataFrame, template: Template = Template(), branches: int | None = None) -> DataFrame:
    """One row per chosen branch: (tree, leaf, branch, branch_score, turns, text, loss).

    ``messages`` has tree, message, parent, role, text and score. ``loss`` are the spans (start, end
    in code points of ``text``) of what is trained on: the texts of the trained roles, without
    control strings.
    """
    messages = written(_distinct(messages), shared_dir(messages.sparkSession, "chat-messages"))
    rows = _with_texts(chosen_paths(messages, branches), messages)
    path = Window.partitionBy("tree", "leaf").orderBy("place")
    before = path.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(template.open), template.escaped(F.col("role")), F.lit(template.close))
    turn = F.struct("place", F.concat("head", "body", F.lit(template.end)).alias("said"), "start", "end", "trained")
    return (
        rows.select("*", head.alias("head"), template.escaped(F.col("text")).alias("body"), F.col("role").isin(*template.trained).alias("trained"))
        .select("*", F.char_length("head").alias("head_chars"), F.char_length("body").alias("body_chars"))
        .select("*", F.coalesce(F.sum(F.col("head_chars") + F.col("body_chars") + len(template.end)).over(before), F.lit(0)).alias("offset"))
        .select("*", (F.col("offset") + F.col("head_chars") + len(template.begin)).alias("start"))
        .select("*", (F.col("start") + F.col("body_chars")).alias("end"))
        .groupBy("tree", "leaf", "branch", "branch_score")
        .agg(F.sort_array(F.collect_list(turn)).alias("said"))
        .select(
            "tree", "leaf", "branch", "branch_score", F.size("said").cast("bigint").alias("turns"),
            F.concat(F.lit(template.begin), F.array_join("said.said", "")).alias("text"),
            F.transform(F.filter("said", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss"),
        )
    )


def turns_of(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    body = F.substr(text, F.lit(len(template.begin) + 1))
    pieces = F.split(body, quoted(template.end), -1)
    parts = lambda piece: F.split(F.substr(piece, F.lit(len(template.open) + 1)), quoted(template.close), 2)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda piece: F.struct(
            template.unescaped(F.get(parts(piece), F.lit(0))).alias("role"), template.unescaped(F.get(parts(piece), F.lit(1))).alias("text")
        ),
    )


def trained_texts(text: Column, loss: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, each as it was before formatting.

    A span is looked up from the start of the text, so the work is turns times length.
    """
    return F.transform(loss, lambda span: template.unescaped(F.substring(text, span["start"] + 1, span["end"] - span["start"])))

"""Link quotations to the messages they quote.

Lines are parsed into quote levels.  Quoted runs of every level, their
paragraphs, lines and sentences are normalised and hashed, and so is what every
message says itself; a quotation is linked to the first message of its thread
that says it.  A message replies to the one from which most of its quotation
comes, at the shallowest level of which anything is found.
Replies form trees, whose roots are found by pointer jumping.

What is said is reduced to the first message per thread and hash before the
join, so a line that everybody repeats is one row of one side; the quoting
side of a hot key is split by the adaptive join.  No thread is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctule.session import stored

PREFIX = r"^[\x20\t]*(?:>[\x20\t]?)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb\b.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$"

#: Where a sentence ends: white space behind its mark, with closing quotes and brackets.
SENTENCE = r"(?:(?<=[.!?…])|(?<=[.!?…][\"'”’»)\]]))\s+"

COUNTS = ("n_quoted", "n_linked", "n_all_quoted", "n_all_linked")


def levels(text: Column) -> Column:
    """Lines as structs of quote level and the line without its marks; attributions before a quote are left out."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, PREFIX, "").alias("line")))
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731 - evaluates value once
    return bound(lines, lambda all_: F.filter(all_, lambda x, i: ~((x["level"] == 0) & x["line"].rlike(ATTRIBUTION)
                                                                  & F.coalesce(F.get(all_, i + 1)["level"] > 0, F.lit(False)))))


def own_text(lines: Column) -> Column:
    """What a message says itself, trimmed; blank lines left by a quotation are reduced to one."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(own, r"\n[\x20\t]*\n(?:[\x20\t]*\n)+", "\n\n"), r"^\s+|\s+$", ""))


def normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def passages(lines: Column, level: Column | int, sentences: bool) -> Column:
    """Distinct normalised passages of a level: its sentences, within lines and over them, or its runs, their paragraphs and lines."""
    # a line of another level ends a run: it is replaced by a form feed
    marked = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["line"]).otherwise("\f")), "\n")
    cut = lambda pattern: F.split(marked, pattern)
    every = F.concat(cut(rf"\f|\n[\x20\t]*\n|{SENTENCE}"), cut(rf"\f|\n|{SENTENCE}")) if sentences else F.concat(cut("\f"), cut(r"\f|\n[\x20\t]*\n"), cut(r"\f|\n"))
    return F.array_distinct(F.filter(F.transform(every, normalised), lambda x: F.length(x) > 0))


def quotations(lines: Column) -> Column:
    """Structs of level, passage and whether it is a sentence only, of every quote level there is."""
    levels = F.array_distinct(F.transform(F.filter(lines, lambda x: x["level"] > 0), lambda x: x["level"]))
    of = lambda level, part: F.transform(passages(lines, level, part), lambda p: F.struct(level.alias("level"), p.alias("p"), F.lit(part).alias("part")))
    return F.flatten(F.transform(levels, lambda level: F.concat(of(level, False), of(level, True))))


def link(messages: DataFrame, thread: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Replace text by what each message says itself; add parent, root, reply_depth, n_quoted, n_linked, n_all_quoted, n_all_linked and links.

    ``parent`` and ``root`` are values of ``order``; a message without linked
    quotation has no parent and is its own root.  Rows are in reply order by
    (thread, root, order): parents precede their replies.  n_quoted and
    n_linked count distinct first-level runs, paragraphs and lines, and those
    that were found in an earlier message; n_all_quoted and n_all_linked count
    the passages of every level, sentences too.  links has the messages that
    passages come from: level, original and the number of its passages, in this
    order.  The shallowest level with a link decides the parent.  Longer passages weigh by their length; ties go to the
    later message.  Rows that repeat thread and order are one message.  NULL
    thread or order: no links, the root is the order itself.  NULL texts say
    nothing and stay NULL; columns of the added names are replaced.
    """
    kept = messages.drop("parent", "root", "reply_depth", *COUNTS, "links")
    parsed = kept.withColumn("_lines", levels(F.col(f"`{text}`")))
    keyed = parsed.select(F.col(f"`{thread}`").alias("t"), F.col(f"`{order}`").alias("o"), "_lines").where("t IS NOT NULL AND o IS NOT NULL")
    quoting = keyed.where(F.exists("_lines", lambda x: x["level"] > 0))
    quoted = stored(quoting.select("t", "o", F.explode(quotations(F.col("_lines"))).alias("q")).select("t", "o", "q.*")
                    .groupBy("t", "o", "level", F.unhex(F.md5("p")).alias("h")).agg(F.max(F.length("p")).alias("w"), F.min("part").alias("part")), "quotes")
    own = F.array_union(passages(F.col("_lines"), 0, False), passages(F.col("_lines"), 0, True))
    said = keyed.join(quoted.select("t").distinct(), "t", "left_semi").select("t", "o", F.explode(own).alias("p"))
    first = said.groupBy("t", F.unhex(F.md5("p")).alias("h")).agg(F.min("o").alias("first"))
    found = quoted.join(first, ["t", "h"], "left").withColumn("first", F.when(F.col("first") < F.col("o"), F.col("first")))
    votes = found.groupBy("t", "o", "level", "first").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"),
                                                          F.count_if((F.col("level") == 1) & ~F.col("part")).alias("n_first"))
    linked = F.col("first").isNotNull()
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    links = votes.groupBy("t", "o").agg(
        total(F.col("n_first"), "n_quoted"), total(F.when(linked, F.col("n_first")), "n_linked"), total(F.col("n"), "n_all_quoted"), total(F.when(linked, F.col("n")), "n_all_linked"),
        F.array_sort(F.collect_list(F.when(linked, F.struct("level", F.col("first").alias("original"), "n")))).alias("links"),
        F.max(F.when(linked, F.struct(-F.col("level"), "w", "first")))["first"].alias("parent"))
    links = stored(links.withColumn("root", F.coalesce("parent", "o")).withColumn("reply_depth", F.when(F.col("parent").isNull(), 0).otherwise(1)), "quote-links")
    while True:
        up = links.where("reply_depth > 0").select("t", F.col("o").alias("root"), F.col("root").alias("_above"), F.col("reply_depth").alias("_more"))
        risen = stored(links.join(up, ["t", "root"], "left"), "quote-roots")
        done = risen.where("_above IS NOT NULL").isEmpty()
        links = risen.select("t", "o", *COUNTS, "links", "parent", F.coalesce("_above", "root").alias("root"),
                             (F.col("reply_depth") + F.coalesce("_more", F.lit(0))).alias("reply_depth"))
        if done:
            break
    out = parsed.join(links.select(F.col("t").alias("_t"), F.col("o").alias("_o"), "parent", F.col("root").alias("_root"), "reply_depth", *COUNTS, "links"),
                      (F.col(f"`{thread}`") == F.col("_t")) & (F.col(f"`{order}`") == F.col("_o")), "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return out.select(*(F.when(F.col(f"`{c}`").isNotNull(), own_text(F.col("_lines"))).alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns),
                      "parent", F.coalesce("_root", F.col(f"`{order}`")).alias("root"), count("reply_depth"), *map(count, COUNTS),
                      F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))

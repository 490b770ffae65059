"""Patterns across conversations: keyed entities, lexical similarity, links within a window, components and alerts.

Links come from equi-joins on what two cases share (a token, a term, a gram), never from a product of all cases. What is asked of all pairs (``bm25_pairs`` and
``gram_cosine`` without ``among``, the best score) is summed block by block (``all_pairs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .all_pairs import shared_sums

WINDOW_DAYS, LEAST_CLUSTER = 14, 3
K1, B = 1.5, 0.75
#: Cases of a token in one time slot above which the slot is cut into parts; how many tasks such a slot's rows are dealt over; parts of a slot that is swept.
CROWD, SALTS, PARTS = 4096, 64, 1024


def entity_tokens(entities: DataFrame, key: bytes) -> DataFrame:
    """(case_id, kind, token) from (case_id, people, places): distinct pseudonyms of names that are not blank."""
    from ..functions.text import entity_name, pseudonym

    def of(kind: str, column: str) -> DataFrame:
        each = entities.select("case_id", F.explode(column).alias("raw")).filter(entity_name(F.col("raw")) != "")
        return each.select("case_id", F.lit(kind).alias("kind"), pseudonym(kind, F.col("raw"), key).alias("token"))

    return of("person", "people").unionByName(of("place", "places")).distinct()


def links(tokens: DataFrame, cases: DataFrame, window_days: float = WINDOW_DAYS) -> DataFrame:
    """Pairs a < b of cases that share a token within the window: shared people, places, entity overlap and days apart.

    ``tokens`` (case_id, kind, token), ``cases`` (case_id, started_at). Both sides are dealt by token and by a time slot as long as
    the window, each case meeting its own slot and the next, so a token in very many cases is joined slot by slot. A slot of over ``CROWD`` cases is cut
    into parts of about as many: each part of the one side meets copies of the whole other side, so no task lists more than a part's links.
    """
    slot = F.floor(F.unix_micros("started_at") / F.lit(window_days * 86_400_000_000.0)).cast("long")
    dated = tokens.join(cases.select("case_id", "started_at"), "case_id").withColumn("slot", slot)
    sizes = tokens.groupBy("case_id", "kind").agg(F.count("*").alias("size")).groupBy("case_id").agg(F.sum(F.when(F.col("kind") == "person", F.col("size")).otherwise(0)).alias("n_people"), F.sum(F.when(F.col("kind") == "place", F.col("size")).otherwise(0)).alias("n_places"))
    crowds = dated.groupBy("kind", "token", "slot").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("kind", "token", "slot", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))

    def with_parts(rows: DataFrame, case: str) -> DataFrame:
        """Rows of a crowd are many of one key: they meet its number of parts on a salt."""
        copied = crowds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64(case), F.lit(SALTS)).cast("int")).join(copied, ["kind", "token", "slot", "_salt"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("_salt")

    own = with_parts(dated.select("kind", "token", F.col("case_id").alias("x"), F.col("started_at").alias("tx"), "slot"), "x")
    left = own.withColumn("part", F.pmod(F.hash("x"), F.col("parts"))).drop("parts")
    other = with_parts(dated.select("kind", "token", F.col("case_id").alias("y"), F.col("started_at").alias("ty"), F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot")), "y")
    right = other.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    apart = F.abs(F.unix_micros("tx") - F.unix_micros("ty")) / F.lit(8.64e10)
    # A pair in one slot meets in both orders, one in neighbouring slots once: order it, then count each token once.
    met = left.join(right, ["kind", "token", "slot", "part"]).filter((F.col("x") != F.col("y")) & (apart <= window_days))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind", "token", apart.alias("days_apart")).distinct()
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("token"))))
    shared = pairs.groupBy("a", "b").agg(F.first("days_apart").alias("days_apart"), of("person").alias("shared_people"), of("place").alias("shared_places"))
    both = shared.join(sizes.toDF("a", "pa", "la"), "a").join(sizes.toDF("b", "pb", "lb"), "b")
    jaccard = lambda s, x, y: F.coalesce(F.try_divide(F.size(s).cast("double"), F.col(x) + F.col(y) - F.size(s)), F.lit(0.0))
    return both.select("a", "b", "days_apart", "shared_people", "shared_places", F.greatest(jaccard("shared_people", "pa", "pb"), jaccard("shared_places", "la", "lb")).alias("entity_overlap"))


def link_counts(tokens: DataFrame, cases: DataFrame, window_days: float = WINDOW_DAYS, parts: int = PARTS) -> DataFrame:
    """(kind, token, n_cases, n_links): how many pairs of cases of each token ``links`` would list for it, without listing any.

    Cases of one time slot as long as the window are all linked. Those of neighbouring slots are if the later one stands no further into its slot than the earlier one
    into its own: both are swept in order of that place, in ``parts`` parts of the slot, each after the sums of the parts before it. Cases of one moment are one row.
    """
    width = int(window_days * 86_400_000_000)
    micros = F.unix_micros("started_at")
    dated = tokens.join(cases.select("case_id", "started_at"), "case_id").select("kind", "token", F.floor(micros / F.lit(width)).cast("long").alias("slot"), F.pmod(micros, F.lit(width)).alias("into"))
    moments = checkpointed(dated.groupBy("kind", "token", "slot", "into").agg(F.count("*").alias("n")))
    inside = moments.groupBy("kind", "token", "slot").agg(F.sum("n").alias("n")).groupBy("kind", "token").agg(F.sum("n").alias("n_cases"), F.sum(F.expr("n * (n - 1) div 2")).alias("inside"))
    earlier = moments.select("kind", "token", "slot", "into", F.col("n").alias("x"), F.lit(0).cast("long").alias("y"))
    later = moments.select("kind", "token", (F.col("slot") - 1).alias("slot"), "into", F.lit(0).cast("long").alias("x"), F.col("n").alias("y"))
    both = earlier.unionByName(later).groupBy("kind", "token", "slot", "into").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).withColumn("part", F.expr(f"into * {parts} div {width}"))
    keys = ["kind", "token", "slot"]
    sums = both.groupBy(*keys, "part").agg(F.sum("y").alias("y"))
    before = sums.select(*keys, "part", (F.sum("y").over(Window.partitionBy(*keys).orderBy("part")) - F.col("y")).alias("before"))
    swept = both.withColumn("here", F.sum("y").over(Window.partitionBy(*keys, "part").orderBy("into"))).filter("x > 0").join(before, [*keys, "part"])
    across = swept.groupBy("kind", "token").agg(F.sum(F.col("x") * (F.col("before") + F.col("here"))).alias("across"))
    return inside.join(across, ["kind", "token"], "left").select("kind", "token", "n_cases", (F.col("inside") + F.coalesce("across", F.lit(0))).alias("n_links"))


def spanning_links(tokens: DataFrame, cases: DataFrame, window_days: float = WINDOW_DAYS) -> DataFrame:
    """(kind, token, a, b): few links that connect exactly what all of ``links`` connect, in number linear in the rows.

    Cases of a token in one time slot as long as the window are all linked, so each is tied to the slot's first; neighbouring slots are
    tied by the last and first case between them if those are near enough. Only aggregates by slot meet, so a token that very many
    cases share is combined before the shuffle.
    """
    width = F.lit(window_days * 86_400_000_000.0)
    micros = F.unix_micros("started_at")
    dated = tokens.join(cases.select("case_id", "started_at"), "case_id").withColumn("slot", F.floor(micros / width).cast("long")).withColumn("t", micros)
    slots = dated.groupBy("kind", "token", "slot").agg(F.min_by("case_id", F.struct("t", "case_id")).alias("first"), F.min("t").alias("t_first"), F.max_by("case_id", F.struct("t", "case_id")).alias("last"), F.max("t").alias("t_last"))
    inside = dated.join(slots, ["kind", "token", "slot"]).filter("case_id <> first").select("kind", "token", F.col("first").alias("a"), F.col("case_id").alias("b"))
    after = slots.select("kind", "token", (F.col("slot") - 1).alias("slot"), F.col("first").alias("b"), F.col("t_first").alias("t_b"))
    across = slots.join(after, ["kind", "token", "slot"]).filter((F.col("t_b") - F.col("t_last")) <= width).select("kind", "token", F.col("last").alias("a"), "b")
    return inside.unionByName(across)


def _term_parts(words: DataFrame) -> DataFrame:
    """(case_id, term, part): what a shared term adds to the score of a pair with this case as its second."""
    tf = checkpointed(words.groupBy("case_id", "term").agg(F.count("*").alias("tf")))
    lengths = tf.groupBy("case_id").agg(F.sum("tf").alias("length"))
    facts = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(facts)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean_length")
    counted = tf.join(lengths, "case_id").join(idf, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return counted.select("case_id", "term", part.alias("part"))


def _scores(parts: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(a, b, bm25) of pairs a < b with a common term; ``among`` keeps those pairs."""
    left, right = parts.select(F.col("case_id").alias("a"), "term"), parts.withColumnRenamed("case_id", "b")
    pairs = left.join(right, "term").filter("a < b") if among is None else among.select("a", "b").join(left, "a").join(right, ["b", "term"])
    return pairs.groupBy("a", "b").agg(F.sum("part").alias("bm25"))


def term_index(parts: DataFrame) -> DataFrame:
    """``parts`` of terms that two cases share at least, with how many have the term (df) and the most that it adds to any score (most)."""
    facts = parts.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")).filter("df > 1")
    return parts.join(facts, "term")


def bm25_seeds(index: DataFrame, each: int = 2, df: int = 16) -> DataFrame:
    """(a, b): each case with those that share one of its ``each`` heaviest terms that ``df`` cases have at most."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("part"), "term"))
    rare = index.filter(F.col("df") <= df)
    heavy = rare.withColumn("place", place).filter(F.col("place") <= each).select("term", F.col("case_id").alias("x"))
    met = heavy.join(rare.select("term", F.col("case_id").alias("y")), "term").filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def bm25_candidates(index: DataFrame, above: float, formed: bool = False) -> DataFrame:
    """(a, b) of all pairs a < b that may score more than ``above``, and few others; with ``formed`` all that were looked at.

    All cases list their terms in one order, rarest first. What a pair scores from its first common term on is at most the sum of the second case's parts from
    there on, and at most the sum of the largest parts that the first case's terms have anywhere. So that term is among those of both at which these sums are
    still above the bound: only these meet, and common terms, which stand last, hardly ever do. Of pairs that meet, those go of which what they share there
    and what may come after it is not enough.
    """
    order = Window.partitionBy("case_id").orderBy("df", "term")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # Sums in another order may differ in their last digits: what is as near as that is a candidate.
    near = F.lit(above * (1 - 1e-9))
    ranked = index.withColumn("own", F.sum("part").over(after)).withColumn("any", F.sum("most").over(after))
    first = ranked.filter(F.col("any") > near).select(F.col("case_id").alias("a"), "term")
    tail = F.coalesce(F.max(F.when(F.col("own") <= near, F.col("own"))).over(Window.partitionBy("case_id")), F.lit(0.0))
    second = ranked.withColumn("tail", tail).filter(F.col("own") > near).select(F.col("case_id").alias("b"), "term", "part", "tail")
    met = first.join(second, "term").filter("a < b")
    if formed:
        return met.select("a", "b").distinct()
    held = met.groupBy("a", "b").agg(F.sum("part").alias("shared"), F.first("tail").alias("tail"))
    # Terms that count for b and stand further down in a's list are not met there: they are looked up.
    out = ranked.filter(F.col("any") <= near).select(F.col("case_id").alias("a"), "term")
    late = held.join(out, "a").join(second.select("b", "term", "part"), ["b", "term"]).groupBy("a", "b").agg(F.sum("part").alias("late"))
    return held.join(late, ["a", "b"], "left").filter(F.col("shared") + F.coalesce("late", F.lit(0.0)) + F.col("tail") > near).select("a", "b")


def best_bm25(parts: DataFrame) -> DataFrame:
    """(top): the largest score of any two cases, without scoring most pairs and with nothing shuffled that grows with pairs.

    Pairs that share a rare, heavy term give a score to beat; then only cases whose terms may add up to more meet, block by block.
    """
    index = checkpointed(term_index(parts))
    own = index.select("case_id", "term", "part")
    found = _scores(own, bm25_seeds(index)).agg(F.max("bm25")).first()[0] or 0.0
    # Sums in another order may differ in their last digits, as in bm25_candidates.
    able = index.groupBy("case_id").agg(F.sum("most").alias("any")).filter(F.col("any") > F.lit(found * (1 - 1e-9))).select("case_id")
    entries = checkpointed(own.join(able, "case_id", "left_semi").select("case_id", "term", F.col("part").alias("w"), F.lit(1.0).alias("scale")))
    rest = shared_sums(entries, binary=True, best=True).agg(F.max("value").alias("rest"))
    return rest.select(F.greatest(F.coalesce("rest", F.lit(0.0)), F.lit(found)).alias("top"))


def bm25_pairs(words: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(a, b, bm25, bm25_norm) for pairs a < b with a common term: distinct terms of a against counts and length of b.

    ``words``: (case_id, term), repeats kept. The norm divides by the largest score of all pairs. ``among`` (a, b) limits the rows to
    given pairs, such as links, but not the norm: without it every two cases with a common term are listed, which suits small sets only.
    """
    parts = checkpointed(_term_parts(words))
    top = best_bm25(parts).first()["top"] or 1.0
    if among is None:
        scored = shared_sums(parts.select("case_id", "term", F.col("part").alias("w"), F.lit(1.0).alias("scale")), binary=True).withColumnRenamed("value", "bm25")
    else:
        scored = _scores(parts, among)
    return scored.select("a", "b", "bm25", (F.col("bm25") / F.lit(top)).alias("bm25_norm"))


def gram_cosine(grams: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of gram counts for pairs a < b with a common gram; other pairs are 0 and left out. ``among`` as in bm25_pairs."""
    tf = checkpointed(grams.groupBy("case_id", "gram").agg(F.count("*").alias("n")))
    norms = tf.groupBy("case_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    if among is None:
        entries = tf.join(norms, "case_id").select("case_id", F.col("gram").alias("term"), F.col("n").cast("double").alias("w"), F.col("norm").alias("scale"))
        return shared_sums(entries).withColumnRenamed("value", "cosine")
    left, right = tf.toDF("a", "gram", "na"), tf.toDF("b", "gram", "nb")
    pairs = among.select("a", "b").join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    return pairs.join(norms.toDF("a", "norm_a"), "a").join(norms.toDF("b", "norm_b"), "b").select("a", "b", (F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("cosine"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component), named by its smallest node, of every node of ``edges`` (a, b), by contraction.

    In each round a node is merged into the neighbour whose hash is smallest, if that is smaller than its own, and edges are drawn between what is left: a
    constant share of the nodes goes, in chains too, so all rounds together cost a few times the first. The merges are then followed backwards.
    A node of very many edges is merged by an aggregate, and is one row once its neighbours are merged into it. Each round is checkpointed.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    left = checkpointed(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    alone = edges.filter("a = b").select(F.col("a").alias("node"))
    merges: list[DataFrame] = []
    while not left.isEmpty():
        if len(merges) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        # The hash is another one in each round, so what is slow for one is not for the next.
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(merges))).alias("h"), F.col(c).alias("n"))
        met = left.select(F.col("u").alias("node"), order("v").alias("other")).unionByName(left.select(F.col("v").alias("node"), order("u").alias("other")))
        into = met.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least(order("node"), "other")["n"].alias("into"))
        merges.append(checkpointed(into))
        to_u, to_v = merges[-1].toDF("u", "to_u"), merges[-1].toDF("v", "to_v")
        moved = left.join(to_u, "u").join(to_v, "v").filter("to_u <> to_v")
        left = checkpointed(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
    if not merges:
        return alone.distinct().select("node", F.col("node").alias("component"))
    found = merges[-1]
    for earlier in reversed(merges[:-1]):
        # What a node was merged into may have been merged on, or have been left without edges.
        found = checkpointed(earlier.join(found.toDF("into", "last"), "into", "left").select("node", F.coalesce("last", "into").alias("into")))
    least = found.groupBy("into").agg(F.min("node").alias("component"))
    named = found.join(least, "into").select("node", "component")
    return named.unionByName(alone.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def describe_links(linked: DataFrame, lexical: DataFrame) -> DataFrame:
    """Link rows as delivered: numbers to 3, 3 and 1 places (halves to even), shared tokens and the reason; ``lexical`` has (a, b, lexical)."""
    count = lambda c, what: F.when(F.size(c) > 0, F.concat(F.size(c).cast("string"), F.lit(f" shared {what}")))
    named = F.filter(F.array(count("shared_people", "person"), count("shared_places", "location")), lambda x: x.isNotNull())
    apart = F.concat(F.lit(", "), F.bround("days_apart", 0).cast("int").cast("string"), F.lit(" days apart"))
    out = linked.join(lexical, ["a", "b"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    return out.select("a", "b", F.bround("entity_overlap", 3).alias("entity_overlap"), F.bround("lexical", 3).alias("lexical"), F.bround("days_apart", 1).alias("days_apart"), "shared_people", "shared_places", F.concat(F.array_join(named, " and "), apart).alias("reason"))


def alert_members(tokens: DataFrame, cases: DataFrame, least: int = LEAST_CLUSTER, window_days: float = WINDOW_DAYS, tied: DataFrame | None = None) -> DataFrame:
    """(cluster_id, case_id, started_at, size): a row for each case of each component of at least ``least`` cases, named by its smallest.

    ``tied``: the spanning links, where they are there already."""
    nodes = components((spanning_links(tokens, cases, window_days) if tied is None else tied).select("a", "b"))
    large = nodes.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return nodes.join(large, "component").withColumnRenamed("node", "case_id").join(cases.select("case_id", "started_at"), "case_id").select(F.concat(F.lit("cluster-"), "component").alias("cluster_id"), "case_id", "started_at", "size")


def alert_facts(members: DataFrame, tokens: DataFrame, cases: DataFrame, window_days: float = WINDOW_DAYS, tied: DataFrame | None = None) -> DataFrame:
    """One row of bounded size for each alert: how many cases and shared tokens, the days they span, and the headline; largest first.

    Chains of links may span more than the window.
    """
    tied = (spanning_links(tokens, cases, window_days) if tied is None else tied).select("kind", "token", F.col("a").alias("case_id"))
    shared = tied.join(members.select("case_id", "cluster_id"), "case_id").groupBy("cluster_id").agg(*[F.count_distinct(F.when(F.col("kind") == k, F.col("token"))).alias(n) for k, n in (("person", "n_people"), ("place", "n_places"))])
    span = (F.unix_micros(F.max("started_at")) - F.unix_micros(F.min("started_at"))) / 8.64e10
    out = members.groupBy("cluster_id").agg(F.count("*").alias("size"), span.alias("span_days")).join(shared, "cluster_id")
    parts = F.array(F.concat(F.col("size").cast("string"), F.lit(" separate reports")), F.when(F.col("n_places") > 0, "naming the same location"), F.when(F.col("n_people") > 0, "naming the same person"))
    headline = F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "), F.lit(", within "), F.bround("span_days", 0).cast("int").cast("string"), F.lit(" days"))
    return out.select("cluster_id", "size", "span_days", "n_people", "n_places", headline.alias("headline")).orderBy(F.desc("size"), "cluster_id")


def alert_tokens(members: DataFrame, tied: DataFrame) -> DataFrame:
    """(cluster_id, kind, token): the people and places that links within an alert share, a row for each."""
    return tied.select("kind", "token", F.col("a").alias("case_id")).join(members.select("case_id", "cluster_id"), "case_id").select("cluster_id", "kind", "token").distinct()


def alert_links(members: DataFrame, linked: DataFrame) -> DataFrame:
    """``linked`` (a, b, ...) with the alert that holds both ends; links tie, so one end says it."""
    return linked.join(members.select(F.col("case_id").alias("a"), "cluster_id"), "a")


def alerts(tokens: DataFrame, cases: DataFrame, tiers: DataFrame | None = None, least: int = LEAST_CLUSTER, window_days: float = WINDOW_DAYS) -> DataFrame:
    """Alerts as a counsellor reads them: the facts, and members in order with their tiers (case_id, tier) in that order, in one row.

    For alerts of some thousand cases at most; ``alert_members`` and ``alert_facts`` give the same of any size.
    """
    tied = checkpointed(spanning_links(tokens, cases, window_days))
    members = checkpointed(alert_members(tokens, cases, least, window_days, tied))
    facts = alert_facts(members, tokens, cases, window_days, tied)
    known = members.withColumn("tier", F.lit(None).cast("string")) if tiers is None else members.join(tiers.select("case_id", "tier"), "case_id", "left")
    listed = known.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "tier"))).alias("m"))
    return facts.join(listed, "cluster_id").select(*facts.columns, F.col("m.case_id").alias("members"), F.transform("m", lambda x: x["tier"]).alias("tiers")).orderBy(F.desc("size"), "cluster_id")


def alerts_of_cases(members: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The alerts that contain each wanted case (case_id)."""
    return members.select("case_id", "cluster_id").join(wanted.select("case_id").distinct(), "case_id", "left_semi").join(facts, "cluster_id")

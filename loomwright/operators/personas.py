"""Personas: prompts, retrieval and generation as one plan; votes; seeded completions; result caches.

A provider is an outside model.  One with ``reply`` (a column of system and user prompt)
or ``vector`` (a column of the text) stays in the plan; others are called in Arrow
batches by ``ingest.respond`` and ``ingest.embedded``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.scalar import clean_reply, dot, seed_of, words
from loomwright.operators import ingest as I
from loomwright.operators import retrieval as R
from loomwright.sources.store import KeyedStore

# --- prompts -----------------------------------------------------------------------------

_FORM = "Give your position in two sentences at most, plainly, without hedging."


def system_prompt(member: Column, bio: Column) -> Column:
    """Who speaks, and the background where there is one."""
    who = F.concat(F.lit("You are "), member, F.lit(", a member of a rate-setting committee."))
    return F.when(F.coalesce(F.length(bio), F.lit(0)) > 0, F.concat(who, F.lit(" Background: "), bio)).otherwise(who)


def bullets(found: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.concat(F.lit("- "), t)), "\n")


def index_prompt(question: Column, found: Column, briefing: Column | None = None) -> Column:
    """The question after the member's statements, and after the conditions of the day where ``briefing`` is given and not null."""
    body = F.concat(F.lit("Statements you have made:\n"), bullets(found), F.lit('\n\nAnswer: "'), question, F.lit(f'"\n\n{_FORM}'))
    return body if briefing is None else F.concat(F.coalesce(F.concat(briefing, F.lit("\n\n")), F.lit("")), body)


def stance_prompt(question: Column, found: Column, briefing: Column | None = None) -> Column:
    """As ``ingest.stance_prompt``; conditions of the day play no part."""
    return I.stance_prompt(question, found)


def vote_prompt(found: Column, briefing: Column) -> Column:
    return F.concat(F.coalesce(briefing, F.lit("")), F.lit("\n\nPositions you have expressed:\n"), bullets(found), F.lit('\n\nHow do you vote? Answer with one word: "hike", "hold" or "cut".'))


def completion_prompt(seed: Column, remaining: Column, found: Column | None = None) -> Column:
    """Goes on from ``seed`` for about ``remaining`` words; with examples where something was retrieved."""
    ask = F.concat(F.lit("Continue the statement in your own voice, with about "), remaining.cast("string"), F.lit(' more words.\n\nStatement: "'), seed, F.lit('"'))
    return ask if found is None else F.concat(F.lit("Statements you have made:\n"), bullets(found), F.lit("\n\n"), ask)


# --- stand-ins that stay in the plan -------------------------------------------------------


class FirstStatement:
    """Replies with the first words of the prompt and of its first statement; without a statement it fails (empty)."""

    def __init__(self, head: int = 8, said: int = 12):
        self.head, self.said = head, said

    def reply(self, system: Column, user: Column) -> Column:
        lines = F.split(user, "\n")
        said = F.get(F.filter(lines, lambda s: F.startswith(s, F.lit("- "))), F.lit(0))
        start = lambda s, n: F.array_join(F.slice(F.split(F.trim(s), r"\s+"), 1, n), " ")
        text = F.concat(start(F.get(lines, F.lit(0)), self.head), F.lit(" "), start(F.substring(said, 3, 1 << 30), self.said))
        return F.when(said.isNull(), "").otherwise(clean_reply(text))


class DigestVotes:
    """Votes by the digest of the prompt's first statement."""

    def reply(self, system: Column, user: Column) -> Column:
        said = F.get(F.filter(F.split(user, "\n"), lambda s: F.startswith(s, F.lit("- "))), F.lit(0))
        place = F.position(F.substring(F.md5(F.substring(said, 3, 1 << 30).cast("binary")), 1, 1), F.lit("0123456789abcdef"))
        return F.when(said.isNull(), "").otherwise(F.get(F.array(F.lit("Hike."), F.lit("a cut"), F.lit("We wait.")), place % 3))


class DigestVectors:
    """Vectors of 32 numbers from the text's digest."""

    model, size = "digest", 32

    def vector(self, text: Column) -> Column:
        digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
        place = lambda i: F.position(F.substring(digest, i, F.lit(1)), F.lit("0123456789abcdef"))
        return F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: place(i).cast("double") - 8.5)


def replied(rows: DataFrame, provider) -> DataFrame:
    """``rows`` (with system and user) with ``response``."""
    if hasattr(provider, "reply"):
        return rows.withColumn("response", F.coalesce(provider.reply(F.col("system"), F.col("user")), F.lit("")))
    return I.respond(rows, provider, F.col("user"))


def with_vectors(rows: DataFrame, provider, column: str = "text") -> DataFrame:
    """``rows`` with ``embedding`` of a text column; each distinct text is embedded once, null as the empty string."""
    text = F.coalesce(F.col(column), F.lit(""))
    if hasattr(provider, "vector"):
        return rows.withColumn("embedding", provider.vector(text))
    from loomwright.functions.scalar import cache_key

    v = I.embedded(rows, provider, column).select(F.col("key").alias("_key"), "embedding")
    return rows.join(v, cache_key(provider.model, provider.size, text) == F.col("_key"), "left").drop("_key")


# --- retrieval and generation ----------------------------------------------------------------


def statements(top: DataFrame, chunks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by..., found: the texts of ranked rows, best first.  Only the winners' texts are moved."""
    said = top.select(*by, "rank", "chunk_id").join(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")), "chunk_id")
    return said.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("found"))


def respond(chunks: DataFrame, members: DataFrame, battery: DataFrame, provider, k: int = 3, bios: DataFrame | None = None, briefing: Column | None = None, prompt: Callable = stance_prompt) -> DataFrame:
    """member, query_idx, response: each member's answer to each question of the battery.

    chunks: chunk_id, member, text, embedding; battery: query_idx, question, q (a vector);
    bios: member, bio.  With ``k`` = 0 nothing is retrieved.  Members without chunks, and
    failed calls, keep the empty response.
    """
    asked = members.select("member").distinct().crossJoin(R.small(battery.select("query_idx", "question")))
    slim = chunks.select("chunk_id", "member", "embedding")
    top = R.top_k(R.scored(slim, battery.select("query_idx", "q")).select("query_idx", "member", "chunk_id", "rel"), k)
    asked = asked.join(statements(top, chunks, ("member", "query_idx")), ["member", "query_idx"], "left")
    asked = asked.join(chunks.select("member").distinct().withColumn("_has", F.lit(True)), "member", "left")
    return _answers(asked, provider, bios, briefing, prompt).select("member", "query_idx", "response")


def respond_at(chunks: DataFrame, roster: DataFrame, battery: DataFrame, provider, k: int = 3, bios: DataFrame | None = None, briefings: DataFrame | None = None, prompt: Callable = index_prompt, top: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """date, member, query_idx, response: the answers of a roster (date, member) at each of its dates.

    ``top`` (date, member, query_idx, chunk_id, rank) may give another ranking than relevance, one for each of a few
    ``settings``, whose columns it then has; so have the answers.  Only chunks ``posted`` on or before a date are retrieved for it; with ``briefings``
    (date, briefing) the answer is given in the light of that day's conditions.  One plan
    for all dates.
    """
    if top is None:
        slim = chunks.where("posted is not null").select("chunk_id", "member", "posted", "embedding")
        scored = R.scored(slim, battery.select("query_idx", "q")).select("query_idx", "member", "chunk_id", "posted", "rel")
        top = R.expanding_top_k(scored, roster.select("date"), k)
    asked = roster.select("date", "member").crossJoin(R.small(battery.select("query_idx", "question")))
    also = settings.columns if settings is not None else []
    if settings is not None:
        asked = asked.crossJoin(R.small(settings))
    keys = [*also, "date", "member", "query_idx"]
    asked = asked.join(statements(top, chunks, tuple(keys)), keys, "left").withColumn("_has", F.lit(True))
    if briefings is not None:
        asked = asked.join(briefings.select("date", "briefing"), "date", "left")
    answers = _answers(asked, provider, bios, F.col("briefing") if briefings is not None else None, prompt)
    return answers.select(*keys, "response")


def _answers(asked: DataFrame, provider, bios, briefing, prompt) -> DataFrame:
    asked = asked.join(bios.select("member", "bio"), "member", "left") if bios is not None else asked.withColumn("bio", F.lit(None).cast("string"))
    asked = asked.withColumns({"system": system_prompt(F.col("member"), F.col("bio")), "user": prompt(F.col("question"), F.col("found"), briefing)})
    return replied(asked, provider).withColumn("response", F.when(F.col("_has"), F.col("response")).otherwise(""))


def mean_position(answers: DataFrame, provider, ax: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by..., position: the mean answer's place on the axis; empty answers are left out."""
    valid = answers.where(F.length("response") > 0)
    return R.on_axis(with_vectors(valid, provider, "response"), ax).groupBy(*by).agg(F.avg("on_axis").alias("position"))


def mean_generated(answers: DataFrame, provider, by: tuple[str, ...]) -> DataFrame:
    """by..., pos, v: the mean vector of all answers; an empty answer is embedded as one blank, not left out."""
    filled = answers.withColumn("response", F.when(F.length("response") > 0, F.col("response")).otherwise(" "))
    return R.mean_vectors(with_vectors(filled, provider, "response"), by)


def committee_index(answers: DataFrame, provider, ax: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., date, index, n_members: the mean over members of their mean answers' places on the axis."""
    each = mean_position(answers, provider, ax, (*by, "date", "member"))
    return each.groupBy(*by, "date").agg(F.avg("position").alias("index"), F.count("*").alias("n_members"))


def vote_at(chunks: DataFrame, roster: DataFrame, question: DataFrame, provider, briefings: DataFrame, k: int = 3) -> DataFrame:
    """date, member, n, vote: each roster member's vote (hike, cut, else hold) from k statements on one question."""
    from loomwright.functions.scalar import vote_of

    answers = respond_at(chunks, roster, question, provider, k, briefings=briefings, prompt=lambda q, found, briefing: vote_prompt(found, briefing))
    return answers.join(roster.select("date", "member", "n"), ["date", "member"]).select("date", "member", "n", vote_of(F.col("response")).alias("vote"))


# --- seeded completions -------------------------------------------------------------------


def held_out(chunks: DataFrame, n_test: int = 40, seed: int = 0, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pool, test): up to ``n_test`` quotes a member of at least ``least`` words, in a seeded hash order; all others."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("chunk_id").cast("string")).cast("binary"))
    good = chunks.where(F.size(words(F.coalesce("quote", F.lit("")))) >= least).select("chunk_id", "member", order.alias("_o"))
    picked = good.withColumn("_r", F.row_number().over(Window.partitionBy("member").orderBy("_o", "chunk_id"))).where(F.col("_r") <= n_test).select("chunk_id")
    return chunks.join(picked, "chunk_id", "left_anti"), chunks.join(picked, "chunk_id")


def complete_seeded(pool: DataFrame, test: DataFrame, provider, k: int = 3, bios: DataFrame | None = None, vectors=None) -> DataFrame:
    """chunk_id, member, seed, quote, response: continuations of held-out quotes from their first half.

    Statements come from the member's pool, nearest to the seed; ``k`` = 0 asks without any.
    Failed (empty) completions are left out.
    """
    t = test.select(F.col("chunk_id").alias("test_id"), "member", "quote", seed_of(F.col("quote")).alias("seed"))
    t = t.withColumn("remaining", F.greatest(F.lit(1), F.size(words(F.col("quote"))) - F.size(words(F.col("seed")))))
    if k:
        q = with_vectors(t.select("test_id", "member", "seed"), vectors, "seed").select("test_id", "member", F.col("embedding").alias("q"))
        near = pool.where("embedding is not null").select("chunk_id", "member", "embedding").join(R.small(q), "member")
        top = R.top_k(near.select("test_id", "member", "chunk_id", dot(F.col("embedding"), F.col("q")).alias("rel")), k, ("test_id", "member"))
        t = t.join(statements(top, pool, ("test_id",)), "test_id", "left")
    t = t.join(bios.select("member", "bio"), "member", "left") if bios is not None else t.withColumn("bio", F.lit(None).cast("string"))
    user = completion_prompt(F.col("seed"), F.col("remaining"), F.col("found") if k else None)
    done = replied(t.withColumns({"system": system_prompt(F.col("member"), F.col("bio")), "user": user}), provider)
    return done.where(F.length("response") > 0).select(F.col("test_id").alias("chunk_id"), "member", "seed", "quote", "response")


def matched(completions: DataFrame, least: int = 3) -> DataFrame:
    """member, chunk_id, generated, real: completion and real continuation, cut to the shorter one's words; ``least`` words or more."""
    g, w = words(F.col("response")), words(F.col("quote"))
    x = completions.select("member", "chunk_id", g.alias("g"), F.slice(w, F.size(words(F.col("seed"))) + 1, F.size(w)).alias("r"))
    x = x.withColumn("m", F.least(F.size("g"), F.size("r"))).where(F.col("m") >= least)
    return x.select("member", "chunk_id", F.array_join(F.expr("slice(g, 1, m)"), " ").alias("generated"), F.array_join(F.expr("slice(r, 1, m)"), " ").alias("real"))


def detect(pairs: DataFrame, folds: int = 5) -> DataFrame:
    """part, accuracy: mean accuracy over stratified folds of telling the two labels of a part apart; 0.5 where a
    label has fewer than two rows.  pairs: part, label, key (orders the folds), embedding."""
    from loomwright.operators.likeness import cross_validated

    size = pairs.groupBy("part", "label").count().groupBy("part").agg(F.min("count").alias("least"), F.count("*").alias("labels"))
    size = size.withColumn("k", F.when(F.col("labels") == 2, F.least(F.col("least"), F.lit(folds))).otherwise(1))
    order = F.md5(F.concat_ws(":", "label", F.col("key").cast("string")).cast("binary"))
    rows = pairs.join(size.where("k >= 2").select("part", "k"), "part")
    rows = rows.withColumn("fold", ((F.row_number().over(Window.partitionBy("part", "label").orderBy(order, "key")) - 1) % F.col("k")).cast("long"))
    told = cross_validated(rows.select("part", "fold", "label", "embedding"))
    by_fold = told.groupBy("part", "fold").agg(F.avg((F.col("true") == F.col("pred")).cast("double")).alias("a"))
    return size.select("part").join(by_fold.groupBy("part").agg(F.avg("a").alias("accuracy")), "part", "left").select("part", F.coalesce("accuracy", F.lit(0.5)).alias("accuracy"))


def detect_taus(completions: DataFrame, vectors, least: int = 8) -> DataFrame:
    """member, n, tau, floor: how well generated and real continuations are told apart, and two halves of the real
    ones, for members of ``least`` matched pairs or more."""
    from loomwright.functions.scalar import detect_tau

    m = matched(completions)
    many = m.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    m = m.join(many, "member")
    half = F.when(F.row_number().over(Window.partitionBy("member").orderBy("chunk_id")) <= F.floor(F.col("n") / 2), "first").otherwise("second")
    both = m.select("member", F.lit("tau").alias("what"), F.lit("generated").alias("label"), F.col("chunk_id").alias("key"), F.col("generated").alias("text"))
    both = both.unionByName(m.select("member", F.lit("tau").alias("what"), F.lit("real").alias("label"), F.col("chunk_id").alias("key"), F.col("real").alias("text")))
    both = both.unionByName(m.withColumn("label", half).select("member", F.lit("floor").alias("what"), "label", F.col("chunk_id").alias("key"), F.col("real").alias("text")))
    rows = with_vectors(both, vectors).select(F.concat_ws("|", "what", "member").alias("part"), "label", "key", "embedding")
    acc = detect(rows).select(F.substring_index("part", "|", 1).alias("what"), F.expr("substring(part, instr(part, '|') + 1)").alias("member"), detect_tau(F.col("accuracy")).alias("t"))
    wide = acc.groupBy("member").agg(*[F.max(F.when(F.col("what") == w, F.col("t"))).alias(w) for w in ("tau", "floor")])
    return many.join(wide, "member").select("member", "n", "tau", "floor")


# --- caches ----------------------------------------------------------------------------------


def cached(rows: DataFrame, path: str, keys: tuple[str, ...], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for ``rows``, kept at ``path`` under ``keys`` (see ``KeyedStore``): only rows whose keys aren't
    there yet are made, and a lookup reads the buckets of its keys.  Nulls are keys like others.

    Returns the kept rows for the keys of ``rows``; of two writers that make the same key, the first to commit counts.
    """
    address = F.sha1(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    store = KeyedStore(rows.sparkSession, path, key="_address")
    return store.fill(rows.withColumn("_address", address), lambda missing: make(missing.drop("_address")).withColumn("_address", address)).drop("_address")

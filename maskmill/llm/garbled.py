"""Finding and repairing texts that were decoded with the wrong character encoding.

Expectation-maximization with a latent encoding chain per record:

* *Units.* A text is seen through its tokens with non-ASCII characters (digits become
  ``#``, outer ASCII punctuation is dropped). A token without ASCII letters is seen
  again after the token before it and before the one after it, because a lone sign such as ``×`` is sound or not only in
  its place, and so are the signs around an ASCII word (``“word”``). Units are counted over the distinct texts of each source, one per text, so
  copies of a text, however many, change nothing but how often its result is given.
* *Candidates.* For every chain of ``charsets`` that a unit can have come out of, the
  unit it came from; it must be plausible and attested in the corpus, or, for words that
  decode as UTF-8 (which sound writing hardly does by chance), earn a fixed bonus.
  Characters that were lost (U+FFFD, dropped controls) are matched by the unit's ASCII
  skeleton, or by what a sound unit would have become; that is the chain ``lost``. One
  that stands between letters or digits earns a bonus even if nothing matches.
* *E-step.* A text under chain ``c`` has each of its units garbled with probability
  ``RHO``; the likelihood ratio of a unit is (count of what it came from) / (its own
  count as sound writing in other texts). A word that decodes as UTF-8 has a ratio of at
  least ``UTF8_LEAST``, however common it is: where a whole source is garbled, its words
  are. A chain is weighed in a text only where at least one unit speaks for it (ratio
  above one, in this round or an earlier one): without, its posterior is below its prior,
  and counts as none. The posterior of each chain follows, with priors per source.
* *M-step.* Priors per source and chain are re-estimated, drawn to those of the whole
  corpus where a source is small; the count of a unit as sound writing loses what the
  posteriors explain as garbled. So records with strong evidence teach what weak
  evidence in others means, and units that begin to speak for a chain bring in new texts.
* The rounds end when the number of garbled texts and the sum of posteriors hold still.

A record is garbled if the posterior of all chains together exceeds one half; it is
repaired unit by unit with its most probable chains. Signs quoted on purpose fail the
test: what they would have come from is not attested between the same neighbours.

Defined results: null, empty and ASCII-only texts are sound. Records with a null key are
not assessed. Equal texts get equal results. Sources may be null (one more source).

No candidate is dropped for its counts. What single-byte code pages do to a word can be
undone as well as done, so only counts tell which of two words is the sound one: a source
garbled so throughout is found only while its words are rarer than the sound ones.

Scale: every text is tokenized once, and its units are written and counted; what follows
reads units, never texts. A round scans the units for those that speak for a chain, and
weighs all evidence only of the texts that hold one. Joins to tables of units are
broadcast after these were measured, or split by hot keys. Texts are scanned anew only in
rounds in which more units speak for a chain.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.llm.charsets import chains, plausible, possible_chains, undo
from maskmill.runtime import cut, fits_broadcast, lookup, release, rows_of, seen

RHO = 0.8
#: Smoothing of unit counts.
ALPHA = 0.1
#: Log-odds for a word that decodes as UTF-8 though the result is nowhere attested.
UTF8_BONUS = 4.0
#: Log-odds for a character that was lost (U+FFFD, a control) between letters or digits.
LOSS_BONUS = 8.0
#: Likelihood ratio that such a word has at least, at any count.
UTF8_LEAST = 5.0
#: Pseudo-texts that draw a source's priors to the corpus'.
POOL = 200.0
FIRST_PRIOR = 0.0005
#: Rounds at most; they end earlier when nothing moves any more.
MOST_ROUNDS = 25
#: Distinct units that one task tries the chains on.
UNITS_PER_TASK = 20_000
#: Share of the sum of posteriors that may still move in the last round.
STILL = 0.001
#: Characters that a sign becomes at most: four bytes, each three characters when read
#: wrong twice.
SIGN = 12
LOST = "lost"
SEP = "\x1f"
#: Stands for the ASCII inside of a token that one sign opens and another closes.
EDGE = "\x1e"
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
_DIGITS = re.compile(r"[0-9]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_LETTER = re.compile(r"[A-Za-z]")
_OUTER = string.punctuation.replace("#", "")
_DAMAGED = re.compile(r"[�\x80-\x9f]|[ÃÂ][^\x00-\x7f]")
_LOSS = re.compile("[\ufffd\x80-\x9f]")
_INSIDE = re.compile("[A-Za-z#][\ufffd\x80-\x9f]+[A-Za-z#]")
_CONTROLS = re.compile("[\x80-\x9f]")
_LONE = re.compile(r"[�\x80-\x9fÃÂâ]+")
_CHAINS = chains()


def normal(token: str) -> str:
    return _DIGITS.sub("#", token).strip(_OUTER)


def skeleton(unit: str) -> str:
    return _OTHER.sub("?", unit)


def _is_sign(token: str) -> bool:
    """Can it have come from a token of one sign, which only its place can tell from a
    garbled one?"""
    return not _LETTER.search(token) and sum(c > "\x7f" for c in token) <= SIGN


def _edges(token: str) -> str | None:
    """The signs around an ASCII word, such as ``“word”``, as a unit of their own; what opens
    is another sign than what closes."""
    if len(token) > 2 and token[0] > "\x7f" < token[-1] != token[0] and token[1:-1].isascii() and _LETTER.search(token):
        return f"{token[0]}{EDGE}{token[-1]}"
    return None


def units_of(text: str | None) -> set[str]:
    """The units of a whole text."""
    if not text or text.isascii():
        return set()
    tokens = _TOKEN.findall(text)
    out: set[str] = set()
    last = len(tokens) - 1
    for i, raw in enumerate(tokens):
        if raw.isascii():
            continue
        token = normal(raw)
        out.add(token)
        if edges := _edges(token):
            out.add(edges)
        if _is_sign(token):
            before = skeleton(normal(tokens[i - 1])) if i else ""
            after = skeleton(normal(tokens[i + 1])) if i < last else ""
            out.add(f"{before}{SEP}{token}{SEP}")
            out.add(f"{SEP}{token}{SEP}{after}")
    return out


def _lone(token: str) -> bool:
    """One sign, or none, that only its place can tell from a garbled one."""
    return len(_OTHER.findall(token)) <= 1 and sum(c > "\x7f" for c in token) <= 1 and not re.search(r"[A-Za-z#]", token)


def candidates_of(unit: str) -> list[tuple[str, str, str, float]]:
    """(chain, key kind, key, bonus) of a unit; kinds are ``exact``, ``skeleton``, ``unknown``
    (lost for good) and, of sound units, ``forward`` (see ``stripped``)."""
    before, mark, rest = unit.partition(SEP)
    token, _, after = rest.partition(SEP) if mark else (unit, "", "")
    out = []
    for chain in possible_chains(token):
        was = undo(token, chain)
        if was is None or (_lone(was) and EDGE not in was) != bool(mark) or not plausible(was.replace(EDGE, "a")):
            continue
        bonus = UTF8_BONUS if chain.startswith("utf-8") and not mark and any(c.isalpha() for c in was) else 0.0
        out.append((chain, "exact", f"{before}{SEP}{was}{SEP}{after}" if mark else was, bonus))
    if mark:
        if _LONE.fullmatch(token):
            out.append((LOST, "skeleton", skeleton(unit), 0.0))
    elif _LOSS.search(token) and re.search("[A-Za-z#]", token) or _DAMAGED.search(token) and len(_LETTER.findall(token)) >= 2:
        out.append((LOST, "skeleton", skeleton(unit), 0.0))
        if _INSIDE.search(token):  # whether or not it is known what was lost
            out.append((LOST, "unknown", unit, LOSS_BONUS))
    return out


def stripped(unit: str) -> str | None:
    """The unit as UTF-8 read as Latin-1 whose control characters were dropped; there is no
    way back from it but through the unit itself. None if nothing was lost."""
    parts = unit.split(SEP)
    at = 1 if len(parts) == 3 else 0
    read = parts[at].encode("utf-8", "replace").decode("latin-1")
    parts[at] = _CONTROLS.sub("", read)
    return SEP.join(parts) if parts[at] != read else None


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for unit, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            lost = stripped(unit) if plausible(unit.replace(SEP, "")) else None
            for row in [*candidates_of(unit), *([(LOST, "forward", lost, 0.0)] if lost else [])]:
                for col, v in zip(cols, (unit, n, *row), strict=True):
                    col.append(v)
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["unit", "n", "chain", "kind", "key", "bonus"])


def candidates(known: DataFrame) -> DataFrame:
    """(unit, n, chain, was, m, bonus) of all units that can have come out of a chain.

    ``known`` has every unit with the number ``n`` of texts that hold it; ``m`` is that of
    the one it came from.
    """
    tasks = max(1, -(-rows_of(known) // UNITS_PER_TASK))
    possible = cut(known.repartition(tasks).mapInArrow(_candidate_rows, "unit string, n long, chain string, kind string, key string, bonus double"))
    # a unit is what few others can have come from, at most one per chain and unit of its length
    exact = possible.filter("kind = 'exact'").join(known.select(F.col("unit").alias("was"), F.col("n").alias("m")), F.col("key") == F.col("was"), "left")
    exact = exact.select("unit", "n", "chain", "key", F.coalesce("m", F.lit(0)).alias("m"), "bonus")
    sound = known.filter(~F.col("unit").rlike("[\\x{FFFD}\\x80-\\x9f]|[ÃÂ][^\\x00-\\x7f]"))
    best = sound.groupBy(F.regexp_replace("unit", "[^\\x00-\\x7f]+", "?").alias("__sk")).agg(F.max(F.struct("n", F.col("unit").alias("was"))).alias("__b"))
    best = cut(best.select("__sk", F.col("__b.was").alias("__was"), F.col("__b.n").alias("__m")))
    lost = lookup(possible.filter("kind = 'skeleton'"), best, "key", "__sk", "inner").filter("__was <> unit")
    lost = lost.select("unit", "n", "chain", F.col("__was").alias("key"), F.col("__m").alias("m"), "bonus")
    # what a sound unit would have become, where that stands in the corpus
    became = possible.filter("kind = 'forward'").groupBy(F.col("key").alias("__as")).agg(F.max(F.struct(F.col("n").alias("m"), F.col("unit").alias("was"))).alias("__b"))
    became = cut(became.select("__as", F.col("__b.was").alias("__was"), F.col("__b.m").alias("__m")))
    forward = lookup(known, became, "unit", "__as", "inner", skewed=False)
    forward = forward.select("unit", "n", F.lit(LOST).alias("chain"), F.col("__was").alias("key"), F.col("__m").alias("m"), F.lit(0.0).alias("bonus"))
    unknown = possible.filter("kind = 'unknown'").select("unit", "n", "chain", "key", F.lit(0).cast("long").alias("m"), "bonus")
    lost = lost.unionByName(forward).unionByName(unknown).groupBy("unit", "n", "chain").agg(F.max_by("key", "m").alias("key"), F.max("m").alias("m"), F.max("bonus").alias("bonus"))
    both = exact.unionByName(lost).withColumnRenamed("key", "was")
    out = cut(both.filter((F.col("m") > 0) | (F.col("bonus") > 0)))
    release(possible, best, became)
    return out


def _tokenized(records: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(id, source, mark, units) of the records with a key and a non-ASCII text; equal texts
    of a source have equal marks. Every text is read and tokenized here, once."""
    base = records.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{text}`").cast("string").alias("text"))
    base = base.filter(F.col("id").isNotNull() & F.col("text").rlike("[^\\x00-\\x7f]"))
    marked = base.select("id", "source", _mark("source", "text").alias("mark"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = pa.array([list(units_of(t)) for t in b.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], units], names=["id", "source", "mark", "units"])

    kind = marked.schema["id"].dataType.simpleString()
    return cut(marked.mapInArrow(run, f"id {kind}, source string, mark binary, units array<string>"))


def _mark(source: str, text: str) -> Column:
    return F.unhex(F.sha2(F.concat_ws(SEP, source, text), 256))


def _scores(ways: DataFrame, explained: DataFrame | None, before: DataFrame | None) -> DataFrame:
    """(unit, ways, chains that it speaks for) under the counts as sound writing. A unit that
    spoke for a chain in the round ``before`` still does; how many more pairs speak now is
    the metric ``fresh``."""
    if explained is None:
        now, clean = ways, F.col("n") - 1.0
    else:
        now = ways.join(explained, F.col("unit") == F.col("__u"), "left")
        clean = (F.col("n") - 1) * F.greatest(F.lit(0.0), 1 - F.coalesce("__e", F.lit(0.0)) / F.col("n"))
    ratio = (F.col("m") + ALPHA * F.exp("bonus")) / (clean + ALPHA)
    ratio = F.greatest(ratio, F.when(F.col("bonus") > 0, UTF8_LEAST).otherwise(0.0))
    scored = now.select("unit", "chain", "was", ratio.alias("ratio"))
    way = F.struct("chain", "was", F.log(1 - RHO + RHO * F.col("ratio")).alias("s"), (RHO * F.col("ratio") / (1 - RHO + RHO * F.col("ratio"))).alias("g"))
    # at most one way a chain
    out = scored.groupBy("unit").agg(F.collect_list(way).alias("ways"), F.collect_list(F.when(F.col("ratio") > 1, F.col("chain"))).alias("hot"))
    size = F.aggregate("ways", F.octet_length("unit"), lambda a, w: a + F.octet_length(w["was"]) + 100)
    if before is None:
        return cut(out, bytes=F.sum(size), fresh=F.sum(F.size("hot")))
    last = before.select(F.col("unit").alias("__b"), F.col("hot").alias("__last"))
    out = out.join(last, F.col("unit") == F.col("__b"), "left").select("unit", "ways", F.array_union("hot", F.coalesce("__last", F.array().cast("array<string>"))).alias("hot"), F.size(F.array_except("hot", "__last")).alias("more"))
    return cut(out, bytes=F.sum(size), fresh=F.sum("more"))


def _near(texts: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, source, unit, chains) of all units of the texts in which some unit speaks for a
    chain, with these chains."""
    fits = fits_broadcast(scores)
    hot = scores.filter(F.size("hot") > 0).select(F.col("unit").alias("__u"), "hot")
    speaking = lookup(texts.select("id", F.explode("units").alias("unit")), hot, "unit", "__u", "inner", fits=fits).select("id", F.explode("hot").alias("chain"))
    active = speaking.groupBy(F.col("id").alias("__id")).agg(F.collect_set("chain").alias("__chains"))
    active = cut(active, bytes=F.sum(F.size("__chains") * 40 + 32))
    out = lookup(texts, active, "id", "__id", "inner", skewed=False).select("id", "source", "__chains", F.explode("units").alias("unit"))
    known = scores.select(F.col("unit").alias("__v"))
    out = cut(lookup(out, known, "unit", "__v", "inner", fits=fits).drop("__v"))
    release(active)
    return out


def _posterior(near: DataFrame, scores: DataFrame, prior: DataFrame | None) -> DataFrame:
    """(id, source, probs, total) of the texts: the posterior of each chain that is weighed
    in a text, and that of all of them. Only sums per text and chain are shuffled."""
    mine = lookup(near, scores.select(F.col("unit").alias("__v"), "ways"), "unit", "__v", "inner", fits=fits_broadcast(scores))
    rows = mine.select("id", "source", "__chains", F.inline("ways")).filter(F.array_contains("__chains", F.col("chain")))
    sums = rows.groupBy("id", "source", "chain").agg(F.sum("s").alias("s"))
    if prior is None:
        sums = sums.withColumns({"prior": F.lit(FIRST_PRIOR), "sound": F.lit(1 - FIRST_PRIOR * (len(_CHAINS) + 1))})
    else:
        sums = lookup(sums.withColumn("__k", F.concat_ws(SEP, "source", "chain")), prior, "__k", "__pk")
    text = Window.partitionBy("id")  # at most one row a chain
    sums = sums.withColumn("lp", F.log("prior") + F.col("s"))
    sums = sums.withColumn("top", F.greatest(F.max("lp").over(text), F.log("sound")))
    sums = sums.withColumn("share", F.exp(F.col("lp") - F.col("top")))
    whole = F.sum("share").over(text) + F.exp(F.log("sound") - F.col("top"))
    shares = sums.withColumn("p", F.col("share") / whole)
    out = shares.groupBy("id", "source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "p"))).alias("probs"), F.sum("p").alias("total"))
    return cut(out, bytes=F.sum(F.size("probs") * 60 + F.octet_length("source") + 60), mass=F.sum("total"), found=F.count_if(F.col("total") > 0.5))


def _weighed(near: DataFrame, scores: DataFrame, post: DataFrame) -> DataFrame:
    """(id, unit, chain, was, w): how far each unit of a text is garbled by each chain."""
    mine = lookup(near.select("id", "unit"), post.select(F.col("id").alias("__id"), "probs"), "id", "__id", "inner", skewed=False)
    mine = lookup(mine, scores.select(F.col("unit").alias("__v"), "ways"), "unit", "__v", "inner", fits=fits_broadcast(scores))
    rows = mine.select("id", "unit", "probs", F.inline("ways")).withColumn("w", F.try_element_at("probs", F.col("chain")) * F.col("g"))
    return rows.filter("w is not null").select("id", "unit", "chain", "was", "w")


def _assessed(tokenized: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """((id, mark) of the distinct texts, posteriors after the last round, a function that
    gives the weighed units of texts with their posteriors)."""
    texts = cut(tokenized.dropDuplicates(["mark"]).withColumn("id", F.monotonically_increasing_id()))
    known = cut(texts.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("n")))
    ways = candidates(known)
    size = texts.groupBy("source").agg(F.count("*").alias("size"))
    size = cut(size.select("source", "size", F.explode(F.array(*[F.lit(c) for c in (*_CHAINS, LOST)])).alias("chain")).withColumn("__pk", F.concat_ws(SEP, "source", "chain")))
    every = max(1, rows_of(texts))
    prior = explained = post = before = scores = near = None
    for _ in range(most_rounds):
        last, scores = scores, _scores(ways, explained, scores)
        if near is None or seen(scores, "fresh"):
            release(*[x for x in (near,) if x is not None])
            near = _near(texts, scores)
        old, post = post, _posterior(near, scores, prior)
        now = (seen(post, "found"), seen(post, "mass") or 0.0)
        release(*[x for x in (last, old, prior) if x is not None])
        if before is not None and now[0] == before[0] and abs(now[1] - before[1]) <= STILL * (1 + now[1]):
            break
        before = now
        explained = _weighed(near, scores, post).groupBy(F.col("unit").alias("__u")).agg(F.sum("w").alias("__e"))
        mass = post.select("source", F.explode("probs").alias("chain", "p")).groupBy("source", "chain").agg(F.sum("p").alias("k"))
        everywhere = mass.groupBy(F.col("chain").alias("__c")).agg(F.sum("k").alias("all_k"))  # one row a chain
        mass = mass.select(F.concat_ws(SEP, "source", "chain").alias("__mk"), "k")
        pooled = size.join(mass, F.col("__pk") == F.col("__mk"), "left").join(F.broadcast(everywhere), F.col("chain") == F.col("__c"), "left")
        value = (F.coalesce("k", F.lit(0.0)) + POOL * F.coalesce("all_k", F.lit(0.0)) / every) / (F.col("size") + POOL)
        per = pooled.select("__pk", "source", F.greatest(value, F.lit(1e-9)).alias("prior"))
        sound = F.greatest(1 - F.sum("prior").over(Window.partitionBy("source")), F.lit(0.05))  # one row a chain
        prior = cut(per.select("__pk", "prior", sound.alias("sound")))
    release(known, ways, size)
    return texts.select("id", "mark"), post, lambda some: _weighed(near, scores, some)


def posteriors(records: DataFrame, key: str, text: str, source: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(id, source, chain, p): the posterior of each chain for a record after the last
    round; records in which no unit speaks for a chain are absent."""
    tokenized = _tokenized(records, key, text, source)
    texts, post, _ = _assessed(tokenized, most_rounds)
    ways = cut(texts.join(post.select(F.col("id").alias("__kind"), "probs"), F.col("id") == F.col("__kind")).select(F.col("mark").alias("__mark"), "probs"))
    return lookup(tokenized.select("id", "source", "mark"), ways, "mark", "__mark", "inner").select("id", "source", F.explode("probs").alias("chain", "p"))


def _found(tokenized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, __mark, __chain, probability) of the garbled texts, their weighed units)."""
    texts, post, weighed = _assessed(tokenized, MOST_ROUNDS)
    best = F.array_max(F.transform(F.map_entries("probs"), lambda e: F.struct(e["value"], e["key"])))
    garbled = post.filter("total > 0.5")
    marked = texts.join(garbled.select(F.col("id").alias("kind"), best["key"].alias("__chain"), F.col("total").alias("probability")), F.col("id") == F.col("kind"))
    return cut(marked.select("kind", F.col("mark").alias("__mark"), "__chain", "probability")), weighed(garbled)


def garbled_records(records: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """((key, chain, probability), weighed units): the garbled records with their likeliest
    chain; the units are those of their distinct texts."""
    tokenized = _tokenized(records, key, text, source)
    found, weighed = _found(tokenized)
    held = lookup(tokenized.select("id", "mark"), found.drop("kind"), "mark", "__mark", "inner")
    best = held.groupBy("id").agg(F.max(F.struct("probability", "__chain")).alias("b"))
    return best.select(F.col("id").alias(key), F.col("b.__chain").alias("chain"), "b.probability"), weighed


def restore(text: str, ways: dict[str, tuple[str, str]], main: str) -> tuple[str, int]:
    """The text with its garbled tokens repaired, and their number.

    ``ways`` gives for a unit the chain to undo and the unit it came from; tokens without
    a way are undone by the record's main chain if that is one of UTF-8 and the result
    is a plausible word.
    """
    tokens = list(_TOKEN.finditer(text))
    names = [normal(t.group()) for t in tokens]
    out, at, changed = [], 0, 0
    for i, t in enumerate(tokens):
        raw = t.group()
        if raw.isascii():
            continue
        way = ways.get(names[i]) or ways.get(_edges(names[i]) or "")
        if way is None and _is_sign(names[i]):
            before = skeleton(names[i - 1]) if i else ""
            after = skeleton(names[i + 1]) if i + 1 < len(names) else ""
            way = ways.get(f"{before}{SEP}{names[i]}{SEP}") or ways.get(f"{SEP}{names[i]}{SEP}{after}")
        fixed = None
        if way and way[0] == LOST:
            was = way[1].split(SEP)[1] if SEP in way[1] else way[1]
            numbers = _DIGITS.findall(raw)
            if was.count("#") == len(numbers):
                for n in numbers:
                    was = was.replace("#", n, 1)
                core = raw.strip(_OUTER)
                fixed = raw.replace(core, was, 1)
        elif way:
            fixed = undo(raw, way[0])
        elif main.startswith("utf-8"):
            was = undo(raw, main)
            fixed = was if was and plausible(was) and not _lone(normal(was)) else None
        if fixed is not None and fixed != raw:
            out.append(text[at : t.start()])
            out.append(fixed)
            at, changed = t.end(), changed + 1
    out.append(text[at:])
    return "".join(out), changed


def repaired_records(records: DataFrame, key: str, text: str, source: str, name: str = "repaired") -> DataFrame:
    """(key, chain, probability, garbled tokens, repaired text) of the garbled records.

    What cannot be restored stays as it is.
    """
    tokenized = _tokenized(records, key, text, source)
    found, weighed = _found(tokenized)
    best = weighed.groupBy("id", "unit").agg(F.sum("w").alias("w"), F.max(F.struct("w", "chain", "was")).alias("b")).filter("w > 0.5")
    ways = best.groupBy(F.col("id").alias("__kind")).agg(F.collect_list(F.struct("unit", "b.chain", "b.was")).alias("ways"))  # a text's own units
    plans = cut(found.join(ways, F.col("kind") == F.col("__kind"), "left").select("__mark", "__chain", "probability", "ways"))
    base = records.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("__source"), F.col(f"`{text}`").cast("string").alias("__text"))
    base = base.filter(F.col("__key").isNotNull() & F.col("__text").rlike("[^\\x00-\\x7f]"))
    joined = lookup(base.select("__key", "__text", _mark("__source", "__text").alias("mark")), plans, "mark", "__mark", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, mains, ways = (b.column(i).to_pylist() for i in (1, 2, 4))
            done = [restore(t or "", {w["unit"]: (w["chain"], w["was"]) for w in ws or []}, m) for t, m, ws in zip(texts, mains, ways, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array([n for _, n in done], pa.int32()), pa.array([t for t, _ in done], pa.string())], names=[key, "chain", "probability", "garbled_tokens", name]
            )

    kind = joined.schema["__key"].dataType.simpleString()
    slim = joined.select("__key", "__text", "__chain", "probability", "ways")
    return slim.mapInArrow(run, f"`{key}` {kind}, chain string, probability double, garbled_tokens int, `{name}` string")

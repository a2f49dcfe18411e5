"""Text cut off by field limits.

First near copies are found by min-hash bands and verified pairs aligned: a text is cut where a longer copy goes on within the word or
unit that the text ends in, and complete where the copy ends a unit there too, alike, and then goes on. What no copy settles is
judged by its own end: what only a cut leaves behind (half a tag, entity or character, a mark of omission), a full stop, and else the
terminality of the closing words: how often the corpus ends a line with them, and how often it goes on, within the last word or
behind it. Words that the corpus has nowhere else are looked at with less of what stands before them. Copies of a text are one piece of evidence.

Each distinct text is read once in Python; what all the steps need of it is stored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quernwork.functions.text import fold_py, source_key
from quernwork.llm.increment import SHINGLE, SIMILAR, _hash, shingle_hashes
from quernwork.llm.survivor import PLACEHOLDERS
from quernwork.session import stored, table

#: Bands and rows of the min-hash signature: a pair of similarity 0.8 shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
#: A bucket of up to so many texts has all its pairs aligned.
SMALL_BUCKET = 16
#: The counts of so many texts are put together before they leave a task.
COUNTED = 2_000
#: A text ends complete if the corpus ends a line with its closing words at least this often when it uses them.
TERMINAL = 0.5

#: Marks of omission; the first group says in words or brackets that text is missing, the second is an ellipsis.
_TOLD = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|truncated|more|cut|suite|continued|read more)\s*\]|\(\s*(?:more|suite|continued|cont\.?|truncated|read more|\.\.\.|…)\s*\)|\b(?:read more|show more|lire la suite|voir plus)\s*(?:\.\.\.|…|»|>)?)\s*$", re.I)
_ELLIPSIS = re.compile(r"\s*(?:\.{2,}|…)\s*$")
_HALF_MARKUP = re.compile(r"<(?:/?[a-z][^<>]*)?$|&(?:#x?[0-9a-f]{0,6}|[a-z]{1,7})$", re.I)
#: "R&D" is no half entity, "gloves&am" is.
_AMPERSAND = re.compile(r"\w&(?!(?:am|nb|qu|lt|gt|ap|nd|md|rs|ls)$)\w{0,2}$")
_PLACEHOLDERS = frozenset(PLACEHOLDERS)
_STOPS = frozenset(".!?。！？।؟")
_OPEN_END = re.compile(r"[,;:(\[\-–—/&]$")
_BREAKS = re.compile(r"</(?:p|li|div|h\d|ul|ol|tr)\s*>|<(?:br|p|li|div)\b[^<>]*>|\n|\r", re.I)
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&(?:[a-z]{2,8}|#\d{1,5});", re.I)
_BULLET = re.compile(r"^\s*(?:[-*•·–]|\d{1,2}[.)])\s+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|@")
_ADDRESS = re.compile(r"https?://\S+\w/?|\S+@[\w-]+(?:\.[\w-]+)+|www\.\S+\w")


def _stops(line: str) -> bool:
    """Whether a line ends with a full stop, closing quotes and brackets aside."""
    return line.rstrip("'\"”’»)]")[-1:] in _STOPS or line[-1:] in "»”"


def _half_markup(text: str) -> int:
    """Where half a tag or entity at the end of a text begins; -1 without one."""
    for at in (text.rfind("<"), text.rfind("&", max(0, len(text) - 10))):
        if at >= 0 and _HALF_MARKUP.match(text, at):
            return at
    return -1


def _lines(text: str) -> list[str]:
    lines = _BREAKS.split(text)
    if "<" in text:
        lines = [_TAG.sub(" ", x) for x in lines]
    if "&" in text:
        lines = [_ENTITY.sub(" ", x) for x in lines]
    return [s for x in lines if (s := x.strip())]


def _tokens(line: str) -> list[str]:
    if "@" in line or "://" in line or "www." in line:
        line = _ADDRESS.sub("@", line)
    return ["#" if t.isdigit() else t for t in _TOKEN.findall(line.lower())]


class Uses:
    """How lines go on and end: counts of (bullet, a, b, w) with kind 0 for words the line goes on behind (the full stop of a sentence included), 1 for ends of lines, 2 for the end of the text, where a cut may be."""

    def __init__(self) -> None:
        self.on, self.ends, self.texts = (Counter(), Counter()), Counter(), 0

    def add(self, lines: list[str]) -> None:
        self.texts += 1
        for at, line in enumerate(lines, 1):
            bullet = bool(_BULLET.match(line))
            body = _BULLET.sub("", line, count=1) if bullet else line
            ws = ["^", "^", *_tokens(body)]
            if len(ws) > 2:
                self.on[bullet].update(zip(ws, ws[1:], ws[2:-1], strict=False))
                stop = _stops(body) and not _ELLIPSIS.search(body, max(0, len(body) - 40))
                self.ends[bullet, *ws[-3:], 0 if stop else 2 if at == len(lines) else 1] += 1

    def columns(self) -> dict[str, list]:
        rows = [(bullet, *k, 0, n) for bullet in (False, True) for k, n in self.on[bullet].items()] + [(*k, n) for k, n in self.ends.items()]
        return dict(zip(_USES, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in _USES}


_USES = ["u_bullet", "u_a", "u_b", "u_w", "u_kind", "u_n"]


def closing(text: str | None) -> tuple[str, bool, str, str, str]:
    """(sign, bullet, a, b, w): what the end of a text says by itself, and the three closing words where the corpus has to say.

    sign: "none" (null, blank and placeholder texts), "cut", "complete", or "ask".
    """
    nothing = (False, "", "", "")
    if not text or not (s := text.rstrip()) or (len(s) < 80 and " ".join(re.findall(r"[^\W_]+", fold_py(s))) in _PLACEHOLDERS):
        return ("none", *nothing)
    if s[-1] == "�" or (_half_markup(s) >= 0 and not _AMPERSAND.search(s[-8:])) or _TOLD.search(s[-80:]):
        return ("cut", *nothing)
    body = _ELLIPSIS.sub("", s)
    lines = _lines(body)
    if not lines:
        return ("none", *nothing)
    bullet = bool(_BULLET.match(lines[-1]))
    last = _BULLET.sub("", lines[-1], count=1)
    if body == s and _stops(last):
        return ("complete", *nothing)
    if _OPEN_END.search(last):
        return ("cut", *nothing)
    return ("ask", bullet, *(["^", "^", *_tokens(last)][-3:]))


def _share(uses: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(by..., w, on, end): how often the words behind `by` are gone on from, within a longer word or behind it, and how often they end a line. Counts of other contexts are dropped before anything is exploded."""
    near = uses.join(asked.select(*by).distinct(), by, "left_semi") if by else uses
    n = near.groupBy(*by, "w").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((0, "on"), (1, "end"), (2, "last"))])
    # a word behind which the line goes on, and every longer word, continue a beginning
    longer = n.filter(F.length("w") > 1).select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring("w", F.lit(1), k))).alias("w"), (F.col("on") + F.col("end") + F.col("last")).alias("on"), F.lit(0).cast("bigint").alias("end"))
    both = longer.unionByName(n.select(longer.columns)).join(asked.select(*by, "w").distinct(), [*by, "w"], "left_semi")
    return both.groupBy(*by, "w").agg(F.sum("on").alias("on"), F.sum("end").alias("end"))


def closing_terminality(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, terminality) of the texts asked (id, bullet, a, b, w): the share of their closing words' uses that end a line; facts as of text_facts().

    A continued word counts for each of its beginnings, so that a cut within a word meets the whole one by an equality
    join. Texts that end with the same words count once for each group of near copies, less the text's own group: copies cut at
    the same place say nothing for each other. Where nothing else has the three closing words, the last two count, then the last; null
    where the corpus has not even that.
    """
    words = ["bullet", "a", "b", "w"]
    zipped = F.arrays_zip(*_USES)
    uses = facts.filter("u_w is not null").select(F.explode(zipped).alias("u")).select(*[F.col(f"u.{c}").alias(c[2:]) for c in _USES])
    known = asked.groupBy(words).agg(F.count("*").alias("n")).join(_share(uses, asked, words[:3]), words, "left").select(*words, "n", F.coalesce("on", F.lit(0)).alias("on"), F.coalesce("end", F.lit(0)).alias("end"))
    known = stored(known, "known-closings")
    # near copies are looked for only where it depends on the other texts' ends whether these words are terminal
    open_words = known.filter(f"n > 1 and (end + on = 0 or end < {TERMINAL} * (end + on)) and end + n - 1 >= {TERMINAL} * (end + n - 1 + on)").select(words)
    ending = stored(asked.join(open_words, words), "open-endings")
    known = known.join(_copy_groups(ending.select("id", F.xxhash64(*words).alias("closing")), facts), F.xxhash64(*words) == F.col("closing"), "left")
    ended = F.col("end") + F.coalesce("groups", "n") - 1
    known = stored(known.select(*words, F.when(ended + F.col("on") > 0, ended / (ended + F.col("on"))).alias("terminality")), "closings")
    less = known.filter("terminality is null").select(words)
    share = F.when(F.col("end") + F.col("on") > 0, F.col("end") / (F.col("end") + F.col("on")))
    for by in (["b"], []):
        less = less.join(_share(uses, less, by).select(*by, "w", share.alias("_".join(["t", *by]))), [*by, "w"], "left")
    less = less.select(*words, F.coalesce("t_b", "t").alias("less"))
    known = known.join(less, words, "left").select(*words, F.coalesce("terminality", "less").alias("terminality"))
    return asked.join(known, words, "left").select("id", "terminality")


def _copy_groups(ending: DataFrame, facts: DataFrame) -> DataFrame:
    """(closing, groups): groups of near copies among the texts of each closing (id, closing). Texts of a closing that share a band, directly or over others, are one group."""
    edges = facts.select("id", "bands").join(ending, "id").select("id", "closing", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("closing", "band", "key").alias("bucket"))
    edges = stored(edges, "ending-bands")
    edges = stored(edges.join(edges.groupBy("bucket").count().filter("count > 1").select("bucket"), "bucket"), "copy-edges")
    # every text takes the smallest id within reach, until none changes; each round is two aggregations
    labels = stored(edges.select("id", F.col("id").alias("label")).distinct(), "labels")
    changed = bool(labels.head(1))
    while changed:
        least = edges.join(labels, "id").groupBy("bucket").agg(F.min("label").alias("label"))
        new = stored(edges.join(least, "bucket").groupBy("id").agg(F.min("label").alias("label")), "labels")
        changed = bool(new.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").head(1))
        labels = new
    return ending.join(labels, "id", "left").groupBy("closing").agg(F.countDistinct(F.coalesce("label", "id")).alias("groups"))


_SEED = np.random.RandomState(20)
# odd multipliers of the full width: the products wrap, so that each function orders the shingles in its own way
_MULT = _SEED.randint(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.randint(0, 2**63, BANDS * ROWS, dtype=np.uint64)


_MARKS = frozenset("¶.")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _units(text: str) -> list[str]:
    """Words of a text, with a mark where a line or sentence ends: "." behind a full stop, "¶" elsewhere."""
    out: list[str] = []
    text = text.rstrip("� \n")
    at = _half_markup(text)
    text = text[:at] if at >= 0 else text
    head, end = text[:-80], text[-80:]  # marks of omission are shorter
    for line in _lines(head + _ELLIPSIS.sub("", _TOLD.sub("", end))):
        body = _BULLET.sub("", line, count=1)
        for part in _SENTENCE.split(body):
            ws = _TOKEN.findall(part.lower())
            if ws:
                out += ws
                out.append("." if _stops(part) else "¶")
    return out


#: Odd multipliers that make one key of the numbers of a band.
_MIX = _SEED.randint(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the min-hash signature of word shingles (shingle_hashes())."""
    sig = ((hashes[:, None] * _MULT + _ADD) >> np.uint64(16)).min(0).reshape(BANDS, ROWS)
    return (sig * _MIX).sum(1).view(np.int64)


def aligned_end(short: str, long: str) -> str | None:
    """What the alignment of a text with its longer near copy says of the text's end: "cut" where the copy goes on within a word or unit, "complete" where the copy ends a unit alike and then goes on, else nothing. Similarity is that of word shingles."""
    a, b = _units(short), _units(long)
    wa, wb = [w for w in a if w not in _MARKS], [w for w in b if w not in _MARKS]
    if len(wa) < SHINGLE + 2 or len(wb) <= len(wa) - 1:
        return None
    sa, sb = ({tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)} for x in (wa, wb))
    if len(sa & sb) < SIMILAR * len(sa | sb):
        return None
    tail, last = wa[-SHINGLE:-1], wa[-1]
    pos = [i for i, w in enumerate(b) if w not in _MARKS]  # where the words of b stand among its units
    best = None
    for i in range(len(wb) - len(tail)):
        if wb[i : i + len(tail)] == tail and wb[i + len(tail)].startswith(last) and (best is None or abs(i - (len(wa) - SHINGLE)) < abs(best - (len(wa) - SHINGLE))):
            best = i
    if best is None:
        return None
    k = pos[best + len(tail)]
    if b[k] != last or b[k + 1] not in _MARKS:
        return "cut"
    return "complete" if b[k + 1] == a[-1] and k + 2 < len(b) else None


def _positions(text: str) -> set[tuple[int, str, str]]:
    """(words, next, behind) for every four words of a text that a word follows: their hash, that word, and what stands behind it: "on" where its line or sentence goes on, the mark of its unit's end where another unit follows, "" at the end of the text."""
    units = _units(text)
    ws = [(w, "on" if units[i + 1] not in _MARKS else units[i + 1] if i + 2 < len(units) else "") for i, w in enumerate(units) if w not in _MARKS]
    return {(_hash(" ".join(w for w, _ in ws[i - SHINGLE + 1 : i]).encode()), *ws[i]) for i in range(SHINGLE - 1, len(ws))}


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, text): each text once, under the smallest of its ids; null and blank ones are left out. Copies meet map-side, so a hot text is one row a task."""
    spec = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("length(trim(text)) > 0")
    return stored(spec.groupBy(F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")).agg(F.min("id").alias("id"), F.any_value("text").alias("text")), "distinct-texts")


def text_facts(texts: DataFrame) -> DataFrame:
    """What one pass over the texts (id, text) gives: id, the sign and words of closing(), size, shingles, tail, last, mark (of the end) and bands of those long enough to align, and, in rows without an id, the counts of Uses."""
    kind = dict(texts.dtypes)["id"]
    schema = f"id {kind}, sign string, bullet boolean, a string, b string, w string, size int, shingles int, tail bigint, last string, mark string, bands array<bigint>, u_bullet array<boolean>, u_a array<string>, u_b array<string>, u_w array<string>, u_kind array<int>, u_n array<bigint>"
    names = ["id", "sign", "bullet", "a", "b", "w", "size", "shingles", "tail", "last", "mark", "bands"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses = Uses()
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                end = closing(t)
                if end[0] == "none":
                    continue
                uses.add(_lines(t))
                units = _units(t)
                ws = [w for w in units if w not in _MARKS]
                more = (None, None, None, None, None, None)
                if len(ws) >= SHINGLE + 2:
                    hashes = shingle_hashes(ws)
                    more = (len(ws), len(hashes), _hash(" ".join(ws[-SHINGLE:-1]).encode()), ws[-1], units[-1], band_keys(hashes))
                rows.append((i, *end, *more))
                if uses.texts >= COUNTED:
                    yield of([], uses)
                    uses = Uses()
            yield of(rows, None)
        yield of([], uses)

    def of(rows: list[tuple], uses: Uses | None) -> pd.DataFrame:
        if uses is not None:
            return pd.DataFrame({c: pd.Series([None], dtype=object) for c in names} | {c: pd.Series([v], dtype=object) for c, v in uses.columns().items()})
        out = {c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(names)}
        return pd.DataFrame(out | {c: pd.Series([None] * len(rows), dtype=object) for c in _USES})

    return stored(texts.select("id", "text").mapInPandas(read, schema), "text-facts")


def aligned_ends(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, end): texts whose alignment with a longer near copy (similarity SIMILAR of five-word shingles or more) settles whether they are cut or complete; "cut" goes before "complete".

    In a bucket of up to SMALL_BUCKET texts each is aligned with every other that is as long and
    near enough in its number of shingles. In larger ones a text meets only those that hold its four words before the last one and
    behind them its last word or a longer one, which either verdict needs: a longer one or a line that goes on for "cut", the end of a unit alike
    with another one behind it for "complete". Of these first two for each of its buckets, then, where
    they settled nothing that goes before, all the others. So every longer near copy that shares a band and says something is met, and
    the ends are those that all pairs of all buckets give, whatever SMALL_BUCKET is.
    """
    kind = dict(texts.dtypes)["id"]
    texts = texts.select("id", "text")

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(b["id"], b["text"], strict=True) for x in _positions(t)], columns=["long_id", "tail", "next", "behind"])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[["id"]].assign(end=[aligned_end(s, t) for s, t in zip(b["text"], b["long"], strict=True)])
            yield b[b["end"].notna()]

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.select("id", "long_id").distinct().join(texts, "id").join(texts.select(F.col("id").alias("long_id"), F.col("text").alias("long")), "long_id")
        return both.mapInPandas(align, f"id {kind}, end string").groupBy("id").agg(F.max("end").alias("end"))

    bands = facts.filter("bands is not null").select("id", "size", "shingles", "tail", "last", "mark", F.posexplode("bands").alias("band", "key"))
    buckets = stored(bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    longer = lambda d: d.select("band", "key", F.col("id").alias("long_id"), F.col("size").alias("long_size"), F.col("shingles").alias("long_shingles"))
    fits = f"long_id <> id and long_size >= size and least(shingles, long_shingles) >= {SIMILAR} * greatest(shingles, long_shingles) - 1e-6"

    few = bands.join(buckets.filter(F.col("n") <= SMALL_BUCKET), ["band", "key"])
    pairs = few.join(longer(few), ["band", "key"]).filter(fits)

    many = stored(bands.join(buckets.filter(F.col("n") > SMALL_BUCKET), ["band", "key"]).drop("n"), "crowded")
    held = texts.join(many.select("id").distinct(), "id", "left_semi").mapInPandas(positions, f"long_id {kind}, tail bigint, next string, behind string")
    says = F.when((F.col("next") != F.col("last")) | (F.col("behind") == "on"), "cut").when(F.col("behind") == F.col("mark"), "complete")
    met = held.join(many.select("tail", "last", "mark").distinct(), "tail").filter(F.col("next").startswith(F.col("last"))).withColumn("says", says).filter("says is not null")
    met = stored(met.select("tail", "last", "mark", "says", "long_id").distinct(), "continued")
    keys = ["band", "key", "tail", "last", "mark"]
    longs = met.join(longer(many), "long_id").join(many.select(keys).distinct(), keys, "left_semi")
    picks = longs.groupBy(*keys, "says").agg(F.max(F.struct("long_size", "long_id", "long_shingles")).alias("longest"), F.max(F.struct(F.xxhash64("long_id", "band").alias("h"), "long_size", "long_id", "long_shingles")).alias("drawn"))
    first = many.join(picks, keys).select("id", "size", "shingles", F.explode(F.array(*[F.struct(*[f"{p}.{c}" for c in ("long_size", "long_id", "long_shingles")]) for p in ("longest", "drawn")])).alias("p")).select("id", "size", "shingles", "p.*").filter(fits)
    first = stored(first.select("id", "long_id").distinct(), "first-pairs")
    settled = stored(aligned(pairs.select("id", "long_id").unionByName(first)), "settled")
    # what only says "complete" matters where nothing else was said
    known = many.join(settled.withColumnRenamed("end", "known"), "id", "left").filter("known is null or known <> 'cut'")
    rest = known.join(longs, keys).filter(f"(says = 'cut' or known is null) and {fits}").select("id", "long_id").distinct().join(first, ["id", "long_id"], "left_anti")
    return stored(settled.unionByName(aligned(rest)).groupBy("id").agg(F.max("end").alias("end")), "aligned")


def judged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, by, cut): every row with a text that is no placeholder, what it was judged by (alignment, end, closing words), and whether the text was cut off.

    Null, blank and placeholder texts are left out; rows with an equal text are judged alike.
    """
    texts = distinct_texts(df, id_col, text_col)
    facts = text_facts(texts)
    known = aligned_ends(facts, texts)
    rest = facts.filter("id is not null").select("id", "sign", "bullet", "a", "b", "w").join(known, "id", "left_anti")
    asked = stored(rest.filter("sign = 'ask'").drop("sign"), "asked")
    words = closing_terminality(facts, asked).select("id", F.lit("closing words").alias("by"), (F.coalesce("terminality", F.lit(1.0)) < TERMINAL).alias("cut"))
    own = rest.filter("sign <> 'ask'").select("id", F.lit("end").alias("by"), (F.col("sign") == "cut").alias("cut"))
    copies = known.select("id", F.lit("alignment").alias("by"), (F.col("end") == "cut").alias("cut"))
    verdict = copies.unionByName(own).unionByName(words).join(texts.select("id", "h1", "h2"), "id").drop("id")
    return df.select(F.col(id_col), F.xxhash64(text_col).alias("h1"), F.hash(text_col).alias("h2")).join(verdict, ["h1", "h2"]).select(id_col, "by", "cut")


def truncated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id): texts that end because text was lost."""
    return judged(df, id_col, text_col).filter("cut").select(id_col).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose description was cut off."""
    return truncated(table(spark, sf_dir, "jobs"), "job_id", "description")


def p5_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source: jobs with a description, truncated ones, and their share."""
    jobs = table(spark, sf_dir, "jobs").filter("length(trim(description)) > 0").select("job_id", source_key("primary_source").alias("source"))
    found = p5_found(spark, sf_dir).withColumn("cut", F.lit(1))
    out = jobs.join(found, "job_id", "left").groupBy("source").agg(F.count("*").alias("jobs"), F.count("cut").alias("truncated"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("jobs"), 4))


def p5_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs are judged by alignment, by their own end, and by closing words, and how many of these are cut."""
    found = judged(table(spark, sf_dir, "jobs"), "job_id", "description")
    return found.groupBy("by").agg(F.count("*").alias("jobs"), F.count_if("cut").alias("truncated"))


QUERIES = {"p5_found": p5_found, "p5_share_by_source": p5_share_by_source, "p5_evidence": p5_evidence}

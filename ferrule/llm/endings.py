"""Texts cut off by field limits or in transfer (problem 10).

Lengths are recomputed under other encodings and escapings, since a limit was often set on one of them.
By source and measure, a length that far more texts have than any near it exposes a hidden limit. Then
the endings are inspected; at a limit, an ending that tells nothing by itself counts as cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import cut

#: A limit is a length that has at least so many texts of a source, and so many times the mean of its surroundings.
LEAST_AT_LIMIT = 6
LEAST_SHARE = 0.01
LEAST_RATIO = 5.0
AROUND = 25
#: A byte limit may leave up to three bytes unused, where a character didn't fit.
BYTE_SLACK = 3


MEASURES = ("chars", "bytes", "utf16", "entities", "entities_bytes", "json", "json_bytes", "json_ascii", "crlf", "crlf_bytes", "lf")
_CONTROL = re.compile(r"[\x00-\x07\x0b\x0e-\x1f]")


def lengths(text: str) -> tuple[int, ...]:
    """Lengths of a text in characters and bytes, as it is, escaped for entities or JSON, or with other line ends."""
    chars = len(text)
    size = wide = pairs = 0
    if text.isascii():
        size = chars
    else:
        size = len(text.encode("utf-8", "surrogatepass"))
        wide = chars - len(text.encode("ascii", "ignore"))
        pairs = len(text.encode("utf-16-le", "surrogatepass")) // 2 - chars
    n = text.count
    entities = 4 * (n("&") + n("'")) + 3 * (n("<") + n(">")) + 5 * n('"')
    escaped = sum(map(n, '"\\\b\f\n\r\t')) + 5 * len(_CONTROL.findall(text))
    pair_ends = n("\r\n")
    bare = n("\n") - pair_ends
    return chars, size, chars + pairs, chars + entities, size + entities, chars + escaped, size + escaped, chars + escaped + 5 * wide + 6 * pairs, chars + bare, size + bare, chars - pair_ends


_MARK = re.compile(r"(?:\[(?:\.\.\.|…|truncated|cut|snip(?:ped)?|more|continued|gekürzt|tronqué|cortado)\]|\((?:\.\.\.|…|truncated|cut(?: off)?|continued|more|shortened|gekürzt|abgeschnitten|tronqué|truncado)\)|<(?:truncated|snip|cut|more)>|\b(?:read|show|see) more)[\s.…]*$", re.I)
_TO_COME = re.compile(r"\b(?:more|continue[sd]?|instal+ments?|next|soon|etc|so on|stay tuned|coming|later|follows?|folgt|fortsetzung|mehr|suite|suivre|continuará|sigue|próxim\w+|más)\b", re.I)
#: Words of a last line, at most, that may end in its author's own dots.
DOTTED_WORDS = 9
_END = re.compile(r"[.!?。！？][\"'»”’)\]*_`]*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'»”’)\]*_`]*[ \t]+")
_SIGNED = re.compile(r"^(?:[\w-]+-by:\s*\S|(?:refs?|fixes|closes|resolves|see(?: also)?|cc|related|issue|ticket|reviewed|author|tags?|labels?)\s*(?:[:#]|to\b)|--\s?\S|—\s*\S|[*_]?(?:regards|cheers|thanks|best|sincerely|yours|gruß|grüße|saludos|cordialement)\b)", re.I)
_ADDRESS = re.compile(r"(?:https?|ftp)://\S|www\.\S")
_WHOLE_LINK = re.compile(r"[^/:]/[\w.#?=&%~-]{3,}>?$|[)>]$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_NAME = re.compile(r"^(?:[^\W\d_][\w.'’-]*)(?:[ ,]+[^\W\d_][\w.'’-]*){0,3}$")
#: A line, or the end of one, that takes leave; a name stands below it.
_LEAVE = re.compile(r"(?:^|\s)(?:(?:best|kind|warm|many|with|viele|mit freundlichen|muchas)\s+)*(?:regards|cheers|thanks|thank you|best|sincerely|yours|gruß|grüße|grüßen|danke|saludos|gracias|cordialement|merci)[\s,.!]*$", re.I)
#: A word that begins a sentence that goes on.
_OPENING = re.compile(r"(?:^|[.!?][\"'»”’)\]*_`]*\s)[ \t]*([^\W\d_]+),? (?=[^\W\d_])", re.M)
#: A word opens sentences, and is no signature, if it opens one in so many times the texts that end with it, and in so many at least.
OPENER_RATIO = 4
LEAST_OPENINGS = 3


def _link(tail: str) -> str | None:
    """Whether ``tail`` ends with a link or address: ``complete``, or ``open`` if it may go on."""
    last = tail.split()[-1] if tail.strip() else ""
    at = last.rfind("@")
    if at > 0 and re.search(r"\.\w+$", last[at:]):
        return "complete" if re.search(r"\.\w{2,}$", last[at:]) else "open"
    middle = tail.rfind("](")
    titled = middle >= 0 and "[" in tail[:middle] and ")" not in tail[middle:-1] and tail.endswith(")")
    if titled or _ADDRESS.search(last):
        return "complete" if titled or _WHOLE_LINK.search(last) else "open"
    return None


def judged(text: str | None) -> tuple[str, str, str | None]:
    """How a text ends, what shows it, and, if that is a word that may be a signature, this word.

    ``complete``, ``cut``, or ``open`` where only a limit can tell; with a word, ``open`` holds unless the
    collection shows that the word, or one that it is the begin of, opens sentences.
    """
    if text is None:
        return "complete", "empty", None
    body = text.rstrip("\x00\x1a \t\r\n\u00a0\u200b\u2028\ufeff")
    if not body:
        return "complete", "empty", None
    if body[-1] == "\ufffd":
        return "cut", "broken character", None
    if len(re.findall(r"^[ \t]*(?:```|~~~)", body, re.M)) % 2:
        return "cut", "code block", None
    lines = body.split("\n")
    last = lines[-1].strip()
    alone = len(lines) == 1 or not lines[-2].strip()
    if re.match(r"^(?:```|~~~)", last):
        return "complete", "code block", None
    if last.startswith("|") and last.endswith("|") and len(last) > 1:
        return "complete", "table", None
    if _MARK.search(body):
        return "cut", "mark", None
    begin = 0
    for m in _SENTENCE.finditer(last):
        begin = m.end()
    tail = last[begin:]
    if body.endswith(("…", "...")):
        ours = _TO_COME.search(last if alone else tail) and len(last.split()) <= DOTTED_WORDS
        return "cut" if not ours else "complete" if body.endswith("...") else "open", "dots", None
    link = _link(tail)
    if link:
        return link, "link", None
    if _SIGNED.match(last) or _SIGNED.match(tail):
        return "complete", "signature", None
    if re.search(r"(?:^|[.!?] )[-*] \S+(?: \S+){0,3}$", last) or _ITEM.match(lines[-1]):
        return "open", "list item", None
    if _END.search(body):
        return "complete", "sentence", None
    if last.endswith("|") and last.count("|") > 2:
        return "complete", "table", None
    if re.match(r"#{1,6}\s", last):
        return "open", "heading", None
    if _NAME.match(tail) and tail != body:
        ws = re.findall(r"[^\W\d_]+", tail)
        if all(w[0].isupper() for w in ws):
            above = next((x for x in reversed(lines[:-1]) if x.strip()), "")
            return ("open", "signature", None) if tail == last and _LEAVE.search(above) else ("open", "word", ws[0].casefold())
    return "cut", "sentence", None


def ending(text: str | None) -> str:
    return judged(text)[0]


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        sizes = [lengths(t) if t is not None else (None,) * len(MEASURES) for t in texts]
        cols = [pa.array([x[k] for x in sizes], pa.int32()) for k in range(len(MEASURES))]
        found = [judged(t) for t in texts]
        said = [pa.array([x[k] for x in found], pa.string()) for k in range(3)]
        openers = pa.array([list({w.casefold() for w in _OPENING.findall(t)}) if t else [] for t in texts], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, *said, openers], names=["doc_id", "source", *[f"len_{k}" for k in MEASURES], "ending", "route", "word", "openers"])


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, source``, the lengths, the ending and the words that open sentences, of every row of ``doc_id, source, text``, in one pass."""
    schema = "doc_id long, source string, " + ", ".join(f"len_{k} int" for k in MEASURES) + ", ending string, route string, word string, openers array<string>"
    return documents.select("doc_id", "source", "text").mapInArrow(_endings, schema)


def opening_words(rows: DataFrame) -> DataFrame:
    """``word``: those that texts of rows of :func:`measured` end with, but that open sentences, or are the begin of one that does."""
    ends = rows.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n_ends"))
    opens = rows.select(F.explode("openers").alias("word")).groupBy("word").agg(F.count("*").alias("n_opens"))
    openers = opens.join(ends.hint("merge"), "word", "left").where(
        (F.col("n_opens") >= LEAST_OPENINGS) & (F.col("n_opens") >= OPENER_RATIO * F.coalesce("n_ends", F.lit(0)))
    )
    begins = openers.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("word")).distinct()
    return ends.select("word").join(begins.hint("merge"), "word", "left_semi")


def limits(rows: DataFrame) -> DataFrame:
    """``source, measure, at_limit, n_at, n_source``: the hidden limits in rows of :func:`measured`.

    Lengths are counted by source, measure and length before anything is compared; the counts of a
    source are as many as it has different lengths.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"len_{k}").alias("len")) for k in MEASURES]))
    counts = rows.where(F.col("len_chars").isNotNull()).select("source", pairs.alias("m")).groupBy("source", "m.measure", "m.len").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source", "measure").orderBy("len")
    slack = F.when(F.col("measure").endswith("bytes"), F.sum("n").over(w.rangeBetween(-BYTE_SLACK, 0))).otherwise(F.col("n"))
    seen = counts.select(
        "source", "measure", "len", "n", slack.alias("n_at"), F.sum("n").over(w.rangeBetween(-AROUND, AROUND)).alias("near"), F.sum("n").over(Window.partitionBy("source", "measure")).alias("n_source"),
    )
    width = F.when(F.col("measure").endswith("bytes"), BYTE_SLACK + 1).otherwise(1)
    beside = (F.col("near") - F.col("n_at")) / F.lit(2.0 * AROUND) * width
    found = seen.where(
        (F.col("n_at") >= LEAST_AT_LIMIT) & (F.col("n_at") >= LEAST_SHARE * F.col("n_source")) & (F.col("n_at") >= LEAST_RATIO * F.greatest(beside, F.lit(0.25)))
    )
    return found.select("source", "measure", F.col("len").alias("at_limit"), "n_at", "n_source")


def truncated(documents: DataFrame) -> DataFrame:
    """``doc_id, source, ending, route, at_limit, is_cut`` of every row of ``doc_id, source, text``.

    Null and empty texts are complete; a null source is a source of its own. ``at_limit`` names a
    measure whose hidden limit the text has reached, null if none; ``route`` is what the ending was told by.
    """
    rows = cut(measured(documents))  # numbers and words only; read by the limits, the words and the result
    found = limits(rows).groupBy("source").agg(F.collect_set(F.struct("measure", "at_limit")).alias("limits"))
    openers = opening_words(rows).withColumn("opens", F.lit(True))

    def reaches(k: str) -> Column:
        slack = BYTE_SLACK if k.endswith("bytes") else 0
        return F.exists("limits", lambda x: (x["measure"] == k) & F.col(f"len_{k}").between(x["at_limit"] - slack, x["at_limit"]))

    reached = F.coalesce(*[F.when(reaches(k), F.lit(k)) for k in MEASURES])
    # few rows end with such a word; the others needn't be moved to meet it
    named = rows.where(F.col("word").isNotNull()).join(openers.hint("merge"), "word", "left").withColumn("ending", F.when(F.col("opens"), F.lit("cut")).otherwise(F.col("ending")))
    rows = rows.where(F.col("word").isNull()).unionByName(named.drop("opens")).drop("openers", "word")
    # a source's limits are at most 1 / LEAST_SHARE a measure; null sources meet by the null-safe comparison
    out = rows.join(F.broadcast(found.withColumnRenamed("source", "limit_source")), F.col("source").eqNullSafe(F.col("limit_source")), "left").withColumn("at_limit", reached)
    return out.select("doc_id", "source", "ending", "route", "at_limit", ((F.col("ending") == "cut") | ((F.col("ending") == "open") & F.col("at_limit").isNotNull())).alias("is_cut"))

"""Generated, minified, vendored and data files among source files (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts with fewer characters, or fewer lines that aren't blank unless they are long, are tiny.
TINY_CHARS = 160
TINY_LINES = 4
#: Unrelated repositories that must share a text, or a subtree of any size.
REPOSITORIES = 3
#: Files that a subtree has at least which only two repositories share.
SUBTREE_FILES = 3
SHINGLE = 5
SIMILARITY = 0.8
#: What an estimate of the similarity may be below it by to be computed exactly; three standard deviations of the estimate.
TOLERANCE = 0.11
PERMUTATIONS = 128
BANDS = 32
CONFIGURATION = {"toml", "ini", "yaml", "json", "cfg", "properties", "xml", "dockerfile", "makefile"}
FILE = ["repository", "username", "relative_path"]

_COMMENT = re.compile(r"^\s*(?://+!?|#+(?!!)|/\*+|\*+(?!/)|--|;+|<!--|\"\"\"|''')\s?(.*?)\s*(?:\*+/|-->|\"\"\"|''')?\s*$")
_SUBJECT = r"(?:this|the)\s+(?:file|code|class|module|source|script|header)\s+(?:(?:is|was|has\s+been)\s+)?"
#: What tools write above (or below) what they make; a mention within a sentence is none.
_GENERATED = re.compile(
    rf"""^\W*(?:
      @generated\b
    | <auto-?generated\b
    | (?:{_SUBJECT})?(?:auto(?:matically)?[\s-]*)?(?:code\s+)?(?:re)?generated\s+(?:code\b|file\b|(?:by|from|with|using|via|on|at|automatically)\s+[\w@"'`<./(-])
    | (?:{_SUBJECT})?auto-?generated\b(?!\s+(?:method|catch|constructor)\s+stub)
    | (?:{_SUBJECT})?(?:produced|created|emitted|built|compiled|transpiled|output)\s+(?:automatically\s+)?by\s+\S+(?:\s+(?:v(?:ersion)?\.?\s*)?\d[\w.]*|\s+(?:from|compiler|generator))
    | source:\s*\S+.*\bre-?generate\b
    | (?:to\s+)?re-?generate\s+(?:this\s+file\s+)?(?:with|by|using|via|from)\b
    | (?:{_SUBJECT})?(?:do\s+not|don't|never)\s+(?:edit|modify|change|touch)(?:\s+(?:this|the)\s+(?:file|code))?(?:\s+(?:by\s+hand|manually|directly|yourself|it))?\s*(?:[.!;:,—-].*)?$
    | (?:{_SUBJECT})?machine[\s-]*(?:made|generated|written|produced)\b
    | (?:generated|machine)[\s-]+(?:file|code|source)\b.*\b(?:do\s+not|don't|overwritten|edit)
    | .*\b(?:manual|hand|local|any|your)\s+(?:edits|changes|modifications)\s+(?:are|will\s+be|get|may\s+be)\s+(?:overwritten|lost|discarded)
    )""",
    re.I | re.X,
)
_TOOL_PATH = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.generated\.\w+|\.g\.(?:dart|cs)|_generated\.\w+|\.designer\.cs)$", re.I)
_VENDOR_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third[_-]?party|vendor(?:ed)?|site-packages)/", re.I)
_MIN_PATH = re.compile(r"[.-](?:min|bundle|pack|prod)\.(?:js|mjs|css|ts)$", re.I)
#: A foreign project's name, version and owner above its code.
_LICENSED = re.compile(r"^\W*(?:[\w@./-]+\s+v?\d+\.\d+(?:\.\d+)?\b.*(?:\(c\)|©|copyright|licen[cs]e)|.*\blicen[cs]ed?\b.*\bupstream\b|.*\bsee\s+upstream\b|@license\b.*v?\d+\.\d+)", re.I)
_NUMBERED = re.compile(r"^\s*(?:[\w]+\s+){0,5}([A-Za-z_]\w*?)_?(\d+)\s*\(", re.M)
_DEFINES = re.compile(r"\s*(?:export|public|private|static|async|def|function|fn|pub|func|int|void|var|let|const)\b")
_LITERAL = re.compile(r"[rbuf]?\"(?:[^\"\\]|\\.)*\"|[rbuf]?'(?:[^'\\]|\\.)*'|(?<![\w$])[-+]?(?:0[xX][\da-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:[a-zA-Z]\w{0,2})?(?!\w)|(?<![\w$])(?:true|false|null|none|nil|True|False|None)(?!\w)")
_REST = re.compile(r"[^\s,;:+.=>\[\](){}-]")


def comment_text(line: str) -> str | None:
    m = _COMMENT.match(line)
    return m[1] if m else None


def tiny(text: str) -> bool:
    body = text.strip()
    lines = sum(1 for x in body.split("\n") if x.strip())
    return len(body) < TINY_CHARS and lines < 8 or lines < TINY_LINES and len(body) < 400


def header(lines: list[str]) -> tuple[list[str], list[str]]:
    """Comments above the first code and below the last."""
    top: list[str] = []
    for x in lines:
        if not x.strip() or x.startswith(("<?php", "#!")):
            continue
        c = comment_text(x)
        if c is None:
            break
        top.append(c)
    end: list[str] = []
    for x in reversed(lines):
        if not x.strip():
            continue
        c = comment_text(x) if not x[:1].isspace() else None
        if c is None:
            break
        end.append(c)
    return top, end


def kind(text: str | None, path: str | None) -> str | None:
    """``generated``, ``minified`` or ``data`` by header and layout, ``licensed`` by a foreign project's header."""
    if not text or tiny(text):
        return None
    lines = text.replace("\r\n", "\n").split("\n")
    top, end = header(lines)
    if any(_GENERATED.match(c) for c in top) or any(_GENERATED.match(c) for c in end) or (path and _TOOL_PATH.search(path)):
        return "generated"
    code = [x for x in lines if x.strip() and comment_text(x) is None and not x.startswith("<?php")]
    if not code:
        return None
    if _serial(code):
        return "generated"
    size = sum(map(len, code))
    literal = [x for x in code if _is_literal(x)]
    if len(code) >= 8 and len(literal) >= 0.8 * len(code) or size >= 1500 and sum(map(len, literal)) >= 0.9 * size and len(literal) >= 2:
        return "data"
    if _minified(code, size, path):
        return "minified"
    if top and any(_LICENSED.match(c) for c in top):
        return "licensed"
    return None


def _serial(code: list[str]) -> bool:
    """Whether the code is functions numbered in order, of bodies that differ in names and numbers only."""
    if len(code) < 10:
        return False
    named = (_NUMBERED.match(x) for x in code if _DEFINES.match(x))
    numbers = [int(m[2]) for m in named if m]
    n = len(numbers)
    if n < 4 or numbers != list(range(n)):
        return False
    shapes: dict[str, int] = {}
    for x in code:
        shape = re.sub(r"\w+", "w", x)
        shapes[shape] = shapes.get(shape, 0) + 1
    return sum(v for v in shapes.values() if v >= n - 1) >= 0.7 * len(code)


def _is_literal(line: str) -> bool:
    """Whether a line is nothing but literals and punctuation."""
    rest, n = _LITERAL.subn("", line)
    return n > 0 and not _REST.search(rest)


def _minified(code: list[str], size: int, path: str | None) -> bool:
    mean = size / len(code)
    blank = sum(x.count(" ") + x.count("\t") for x in code) / max(1, size)
    marks = sum(x.count(";") + x.count("{") + x.count("}") + x.count(",") for x in code) / len(code)
    named = bool(path and _MIN_PATH.search(path))
    return (mean >= 150 and blank < 0.12 and marks >= 12) or (named and mean >= 80 and blank < 0.2)


# --- Spark -----------------------------------------------------------------------------------------

_WORDS = re.compile(r"\w+")
_MERSENNE = np.uint64((1 << 61) - 1)


def _shingles(text: str, known: dict[str, int]) -> np.ndarray:
    """The hashes of the five-word shingles, sorted."""
    ws = _WORDS.findall(text)
    n = len(ws) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    codes = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = c
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ codes[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return np.unique(h)


def _signature(h: np.ndarray) -> np.ndarray:
    out = np.empty(PERMUTATIONS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, PERMUTATIONS, 16):
            a, b = _A[k : k + 16, None], _B[k : k + 16, None]
            best = None
            for lo in range(0, len(h), 8192):
                x = (h[None, lo : lo + 8192] * a + b) >> np.uint64(32)
                m = x.min(axis=1)
                best = m if best is None else np.minimum(best, m)
            out[k : k + 16] = best
    return out


_rng = np.random.default_rng(11)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


#: Files whose keys, about a hundred bytes each, may be broadcast.
FEW_FILES = 50_000


def digest_of(text: str | None) -> str | None:
    """The same for texts that differ in line ends and blanks around lines only; null if there is nothing else."""
    body = "\n".join(x.rstrip() for x in text.replace("\r\n", "\n").split("\n")).strip() if text else None
    return xxhash.xxh3_128_hexdigest(body) if body else None


OWN = ("generated", "minified", "data")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    done: set[str] = set()
    for b in batches:
        if len(known) > 500_000:
            known.clear()
        kinds, digests, small, signatures = [], [], [], []
        for t, p in zip(b.column(b.num_columns - 1).to_pylist(), b.column(2).to_pylist()):
            k = kind(t, p)
            digest = digest_of(t)
            little = t is None or tiny(t)
            kinds.append(k)
            digests.append(digest)
            small.append(little)
            h = None
            if digest and not little and k not in OWN and digest not in done:  # of copies in one task, one is signed
                if len(done) < 500_000:
                    done.add(digest)
                h = _shingles(t, known)
            signatures.append(_signature(h).astype(np.uint32).tobytes() if h is not None and len(h) else None)
        more = [pa.array(kinds, pa.string()), pa.array(digests, pa.string()), pa.array(small, pa.bool_()), pa.array(signatures, pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "kind", "digest", "is_tiny", "signature"])


def kind_by_place() -> Column:
    """The kind that ``relative_path`` alone tells, null if none."""

    def at(p: re.Pattern) -> Column:
        return F.col("relative_path").rlike("(?i)" + p.pattern)

    return F.when(at(_TOOL_PATH), "generated").when(at(_VENDOR_PATH), "vendored").when(at(_MIN_PATH), "minified")


def judge(files: DataFrame, *more: str) -> DataFrame:
    """``repository, username, relative_path``, ``more``, and what the text alone tells of rows with ``text``.

    ``kind, digest, is_tiny``, and of the first of equal texts in a task ``signature``. The text isn't
    carried on.
    """
    rows = files.select(*FILE, *more, "text")
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(_judged, carried + ", kind string, digest string, is_tiny boolean, signature binary")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree so much that the texts may be similar."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) if b.num_rows else np.empty((0, PERMUTATIONS), np.uint32) for k in (2, 3))
        keep = pa.array(np.flatnonzero((x == y).mean(axis=1) >= SIMILARITY - TOLERANCE))
        yield pa.RecordBatch.from_arrays([b.column(k).take(keep) for k in (0, 1)], names=["digest", "known"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        if len(known) > 500_000:
            known.clear()
        texts = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in texts], pa.string()), pa.array([_shingles(t, known).tobytes() if t else None for t in texts], pa.binary())], names=["digest", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests whose shingles are similar to the known text's."""
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both >= SIMILARITY * (len(p) + len(q) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64()))], names=["digest"])


def subtree_hashes(files: DataFrame) -> DataFrame:
    """``repository, username, folder, subtree, n`` for ``repository, username, relative_path, digest``.

    Merkle hashes from the deepest folders up: a folder's hash is made of the names and hashes of what lies in it,
    files and folders alike, and so of its whole subtree. The children are summed up, which can be done partially
    before the shuffle and in any order, so a folder may hold most files. ``n`` counts the files below.
    """
    from ferrule.session import cut

    owner = ["repository", "username"]
    parts = F.split("relative_path", "/")
    nodes = files.where(F.col("digest").isNotNull() & F.col("relative_path").isNotNull()).select(
        *owner, F.slice(parts, 1, F.size(parts) - 1).alias("folder"), F.element_at(parts, -1).alias("name"), F.xxhash64(F.lit("file"), "digest").alias("h"), F.lit(1).cast("long").alias("n")
    ).withColumn("depth", F.size("folder"))
    nodes = cut(nodes)
    below, out = None, None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, 0, -1):
        here = nodes.where(F.col("depth") == depth).drop("depth")
        here = here if below is None else here.unionByName(below)
        made = here.groupBy(*owner, "folder").agg(F.sum(F.xxhash64("name", "h").cast("decimal(20,0)")).alias("s"), F.count("*").alias("k"), F.sum("n").alias("n"))
        level = cut(made.select(*owner, "folder", F.xxhash64(F.lit("folder"), "s", "k").alias("subtree"), "n"))
        below = level.where(F.size("folder") > 1).select(*owner, F.slice("folder", 1, F.size("folder") - 1).alias("folder"), F.element_at("folder", -1).alias("name"), F.col("subtree").alias("h"), "n")
        out = level if out is None else out.unionByName(level)
    if out is None:
        return nodes.select(*owner, F.lit("").alias("folder"), F.lit(0).cast("long").alias("subtree"), "n").where(F.lit(False))
    return out.withColumn("folder", F.array_join("folder", "/"))


def _in_shared_subtrees(rest: DataFrame) -> DataFrame:
    """``digest`` of the files below folders that unrelated repositories have in common."""
    trees = subtree_hashes(rest)
    by_hash = trees.groupBy("subtree").agg(F.count_distinct("repository").alias("r"), F.max("n").alias("n"))
    known = by_hash.where((F.col("r") >= REPOSITORIES) | (F.col("r") >= 2) & (F.col("n") >= SUBTREE_FILES))
    common = trees.join(known.hint("merge"), "subtree", "left_semi").select("repository", "username", "folder")
    p = F.split("relative_path", "/")
    above = rest.select("repository", "username", "digest", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - 1)), lambda k: F.array_join(F.slice(p, F.lit(1), k), "/"))).alias("folder"))
    return above.join(common.hint("merge"), ["repository", "username", "folder"], "left_semi").select("digest").distinct()


def _patched(rest: DataFrame, vendored: DataFrame, texts: DataFrame) -> DataFrame:
    """``digest`` of texts similar to a vendored one, searched in bands of their signatures.

    Of the vendored texts in one band, one stands for all at first; only texts that aren't similar to any of these
    are compared with the others, so that a band of many near-equal texts costs each of them one comparison. Only the
    texts of pairs whose signatures agree are read again, to compute their similarity exactly.
    """
    from ferrule.session import cut

    signed = cut(rest.where(F.col("signature").isNotNull()).select("digest", "signature").dropDuplicates(["digest"]))
    step = PERMUTATIONS // BANDS * 4
    bands = signed.select("digest", F.posexplode(F.array(*[F.xxhash64(F.substring("signature", 1 + k * step, step)) for k in range(BANDS)])).alias("band", "h"))
    theirs = cut(bands.join(vendored.hint("merge"), "digest", "left_semi").withColumnRenamed("digest", "known"))
    ours = bands.join(vendored.hint("merge"), "digest", "left_anti")

    def similar(candidates: DataFrame) -> DataFrame:
        of_known = signed.withColumnsRenamed({"digest": "known", "signature": "theirs"})
        both = candidates.join(signed.hint("merge"), "digest").join(of_known.hint("merge"), "known")
        near = cut(both.select("digest", "known", "signature", "theirs").mapInArrow(_near, "digest string, known string"))
        ids = near.select(F.explode(F.array("digest", "known")).alias("digest")).distinct()
        files = cut(rest.select(*FILE, "digest").join(ids.hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(*FILE)).alias("f")).select("f.*"))
        files = F.broadcast(files) if files.count() <= FEW_FILES else files.hint("merge")
        sets = texts.join(files, FILE, "left_semi").select("text").mapInArrow(_shingled, "digest string, shingles binary").dropDuplicates(["digest"])
        of_known = sets.withColumnsRenamed({"digest": "known", "shingles": "theirs"})
        return near.join(sets.hint("merge"), "digest").join(of_known.hint("merge"), "known").select("digest", "shingles", "theirs").mapInArrow(_alike, "digest string").distinct()

    first = cut(similar(ours.join(theirs.groupBy("band", "h").agg(F.min("known").alias("known")).hint("merge"), ["band", "h"]).select("digest", "known").distinct()))
    left = ours.join(first.hint("merge"), "digest", "left_anti")
    return first.union(similar(left.join(theirs.hint("merge"), ["band", "h"]).select("digest", "known").distinct()))


def not_handwritten(files: DataFrame) -> DataFrame:
    """``repository, username, relative_path, kind`` of the files that nobody wrote for their repository.

    ``files``: these columns with ``language`` and ``text``, a row for each file. Kinds: ``generated``,
    ``minified``, ``data``, ``vendored``. Empty and tiny texts, null texts and configuration languages
    are never reported. A text that at least ``REPOSITORIES`` repositories hold, that lies in a subtree shared by as
    many, or by two if it has ``SUBTREE_FILES`` files, or that has a foreign project's header or place, is vendored,
    and so is every text whose five-word shingles have a similarity of at least ``SIMILARITY`` to one of these
    (patched copies). Near copies are searched between different texts only, one row for each, so that a text with
    any number of copies is one row; files and texts stay distributed throughout.
    """
    from ferrule.session import cut

    return decided(cut(judge(files, "language")), files.select(*FILE, "text"))


def decided(judged: DataFrame, texts: DataFrame) -> DataFrame:
    """The result of :func:`not_handwritten` from rows of :func:`judge` with ``language``, and the texts by file.

    ``texts`` may hold more versions of a file than the one that was judged; texts are told by their digest.
    """
    from ferrule.session import cut

    seen = judged.where(~F.coalesce(F.lower("language").isin(*CONFIGURATION), F.lit(False)) & ~F.col("is_tiny"))
    is_own = F.coalesce(F.col("kind").isin(*OWN), F.lit(False))
    own = seen.where(is_own).select(*FILE, "kind")
    rest = seen.where(~is_own)
    shared = rest.groupBy("digest").agg(F.count_distinct("repository").alias("n"), F.max((F.col("kind") == "licensed") | F.col("relative_path").rlike("(?i)" + _VENDOR_PATH.pattern)).alias("foreign"))
    vendored = cut(shared.where((F.col("n") >= REPOSITORIES) | F.coalesce("foreign", F.lit(False))).select("digest").union(_in_shared_subtrees(rest)).distinct())
    copies = rest.join(vendored.union(_patched(rest, vendored, texts)).distinct().hint("merge"), "digest", "left_semi").select(*FILE, F.lit("vendored").alias("kind"))
    return own.union(copies)

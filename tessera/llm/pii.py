"""Personal data in texts: exact base kinds, and identifiers found by bootstrapped contexts.

One pass finds the base entities with linear-time scanners and, beside them, the tokens and
the runs of number tokens that look like identifiers but are no base entity. Both carry their lexical patterns: the two words
before (``L``), and the word on each side (``B``). Patterns and instances form a bipartite
graph. Spark scores it for a few rounds: a pattern's confidence in a kind is the score of its
distinct instances over their number plus one, an instance's score is that of its best trusted
pattern; base entities are the seeds with score one. Tokens of a fitting shape in a trusted
pattern become spans of that kind. The rounds work on counts per pattern, so what moves grows
with the identifiers of the corpus, not with its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import durable, small_batches

KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted with so many distinct instances of score and so much confidence.
MIN_SUPPORT = 10
MIN_CONFIDENCE = 0.8
ROUNDS = 3
#: Rows of a table that may be broadcast to redact texts.
BROADCAST_ROWS = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
_NUMBERS = re.compile(r"[+(]?[0-9][0-9().:/_+-]*")
_QUAD = re.compile(r"[0-9]{1,3}([.:_-])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}")
_JOINT = re.compile(r"[ \t\u00a0().-]+")
_SIZES = ((2, 13, 19), (3, 7, 15))
_OPEN, _CLOSE = "([{<\"'", ".,;:!?)]}>\"'"
#: A longer token is known by its hash.
_NAMED = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start; leftmost and disjoint within a kind."""
    spans = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                spans.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


def _patterns(text: str, start: int, end: int) -> tuple[str, str]:
    before = [_DIGIT.sub("0", w.lower()) for w in text[max(0, start - 80) : start].split()[-2:]]
    after = [_DIGIT.sub("0", w.lower()) for w in text[end : end + 40].split()[:1]]
    left, right = (before[-1] if before else "^"), (after[0] if after else "$")
    return "L " + " ".join(before or ["^"]), f"B {left} _ {right}"


def _shapes(token: str) -> list[int]:
    """Kinds whose instances may look like this token."""
    at = token.find("@")
    if at > 0 and at < len(token) - 1:
        return [0]
    if not _NUMBERS.fullmatch(token):
        return []
    digits = _digits(token)
    if _QUAD.fullmatch(token):
        return [1]
    return [k for k, lo, hi in _SIZES if lo <= digits <= hi]


def _digits(token: str) -> int:
    return len(_DIGIT.findall(token))


def _tokens(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """``(start, end, token)`` of the tokens with a digit or @ that touch no base span, without what encloses them."""
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    k, upto = 0, 0
    for m in _MARK.finditer(text):
        start, end = m.span()
        while start > upto and not text[start - 1].isspace():
            start -= 1
        upto = end
        while start < end and text[start] in _OPEN:
            start += 1
        while end > start and text[end - 1] in _CLOSE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start < end and (k == len(taken) or taken[k][0] >= end):
            yield start, end, text[start:end]


def _run(text: str, run: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, list[int]]]:
    """Candidates of number tokens that stand in a row: those that fit alone, and the longest rows of the others."""
    counts, alone = [_digits(t) for _, _, t in run], [_shapes(t) for _, _, t in run]
    at = 0
    for i, (start, end, token) in enumerate(run):
        if alone[i]:
            yield start, end, token, alone[i]
            at = max(at, i + 1) if at == i else at
        if i < at or alone[i]:
            continue
        ends: dict[int, int] = {}  # kind: last token of its longest row
        total = 0
        for j in range(i, len(run)):
            total += counts[j]
            if total > 19 or (ends and alone[j]):
                break
            ends |= {k: j for k, lo, hi in _SIZES if j > i and lo <= total <= hi}
        if not ends:
            if counts[i] >= 6:
                yield start, end, token, []
            at = i + 1
            continue
        at = max(ends.values()) + 1
        value = text[start : run[at - 1][1]]
        for j in sorted(set(ends.values())):
            stop = run[j][1]
            opened = start - (start > 0 and text[start - 1] == "(" and ")" in text[start:stop])
            yield opened, stop, value, [k for k in sorted(ends) if ends[k] == j]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, list[int]]]:
    """``(start, end, value, kinds)`` of identifier-like tokens and rows of number tokens that touch no base span."""
    found: list[tuple[int, int, str, list[int]]] = []
    run: list[tuple[int, int, str]] = []
    for start, end, token in _tokens(text, spans):
        number = _NUMBERS.fullmatch(token)
        if run and not (number and _JOINT.fullmatch(text, run[-1][1], start)):
            found += _run(text, run)
            run = []
        if number:
            run.append((start, end, token))
        elif kinds := _shapes(token):
            found.append((start, end, token, kinds))
        elif "@" in token and len(token) >= 5 or _digits(token) >= 6:
            found.append((start, end, token, []))
    return found + list(_run(text, run))


_SCANNED = "id {}, digest bigint, base array<struct<kind:int,s:int,e:int>>, seen array<struct<kind:int,s:int,e:int,value:string,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base spans, and every instance with its patterns.

    ``seen.kind`` is a base kind for seeds, 4 + kind for a token or row of a fitting shape and -1
    for an identifier-like token of no kind's shape. Null texts count as empty.
    """
    schema = _SCANNED.format(docs.schema[id_col].dataType.simpleString())
    base_type = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
    seen_type = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for text in (t.as_py() for t in batch.column(2)):
                spans = base_spans(text or "")
                base.append([{"kind": k, "s": s, "e": e} for k, s, e in spans])
                own = [{"kind": k, "s": s, "e": e, "value": text[s:e], "patterns": _patterns(text, s, e)} for k, s, e in spans]
                if text and _MARK.search(text):
                    for s, e, value, kinds in candidates(text, spans):
                        p, name = _patterns(text, s, e), value if len(value) <= _NAMED else xxhash.xxh3_128_hexdigest(value.encode("utf-8", "surrogatepass"))
                        own += [{"kind": 4 + k if k >= 0 else k, "s": s, "e": e, "value": name, "patterns": p} for k in kinds or [-1]]
                seen.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, base_type), pa.array(seen, seen_type)], ["id", "digest", "base", "seen"])

    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(per_batch, schema)


def trusted_patterns(scanned: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame | None:
    """``(pattern, kind, confidence)`` of the patterns trusted in the end; None if there is none."""
    seen = scanned.select(F.explode("seen").alias("i")).select("i.kind", "i.value", F.explode("i.patterns").alias("pattern")).distinct()
    edges = durable(seen.select("pattern", "value", F.when(F.col("kind") > 3, F.col("kind") - 4).otherwise(F.col("kind")).alias("kind"), F.col("kind").between(0, 3).alias("seed")))
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"))
    scores = edges.where("seed").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    trusted = None
    for _ in range(rounds):
        known = edges.select("pattern", "value", "kind").join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count_distinct("value").alias("support"))
        # Few instances stay below the support whatever their total, so the totals join is small.
        now = known.where(F.col("support") >= min_support).join(totals, "pattern").select("pattern", "kind", (F.col("score") / (F.col("n") + 1)).alias("confidence"))
        now = durable(now.where(F.col("confidence") >= min_confidence))
        if now.isEmpty():
            return trusted
        trusted = now
        fresh = edges.where("not seed and kind >= 0").join(now, ["pattern", "kind"]).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        seeds = edges.where("seed").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
        scores = seeds.unionByName(fresh.join(seeds.drop("score"), ["value", "kind"], "left_anti"))
    return trusted


def discovered(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(rid, more)``: the spans that trusted patterns add, the most trusted kind for each token."""
    tokens = scanned.select("rid", F.explode("seen").alias("i")).where("i.kind > 3").select("rid", "i.s", "i.e", (F.col("i.kind") - 4).alias("kind"), F.explode("i.patterns").alias("pattern"))
    best = tokens.join(trusted, ["pattern", "kind"]).groupBy("rid", "s", "e").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    return best.groupBy("rid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``(id, digest, base, spans)`` for every row: the base spans, and those with the discovered ones.

    Null and empty texts have none. Rows are kept apart by a row number, so repeated and null
    ids do no harm. An empty table gives an empty result.
    """
    scanned = durable(scan(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    trusted = trusted_patterns(scanned, **params)
    if trusted is None:
        return scanned.select("id", "digest", "base", F.col("base").alias("spans"))
    joined = scanned.join(discovered(scanned, trusted), "rid", "left")
    return joined.select("id", "digest", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")))).alias("spans"))


def _listed(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"], x["e"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """Spans in all documents. The counts are those of the base spans."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans are replaced as one."""
    parts, upto = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= upto:
            parts += [text[upto:s], f"[{KINDS[k].upper()}]"]
        upto = max(upto, e)
    return "".join([*parts, text[upto:]])


def redact(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **params) -> DataFrame:
    """``docs`` with all spans in ``text`` replaced, and ``n_chars`` set anew; every row stays.

    Null texts stay null. Other columns stay as they are.
    """
    columns, schema = docs.columns, docs.schema
    scanned = durable(scan(docs).withColumn("rid", F.monotonically_increasing_id()))
    trusted = trusted_patterns(scanned, **params)
    more_type = "array<struct<kind:int,s:int,e:int>>"
    if trusted is None:
        ready = docs.withColumn("__more", F.lit(None).cast(more_type))
    else:
        more = scanned.join(discovered(scanned, trusted), "rid").groupBy("id", "digest").agg(F.any_value("more").alias("__more"))
        more = durable(more.withColumnsRenamed({"id": "__id", "digest": "__digest"}))
        side = F.broadcast(more) if more.count() <= broadcast_rows else more
        ready = docs.join(side, docs["doc_id"].eqNullSafe(more["__id"]) & (F.xxhash64(docs["text"]) == more["__digest"]), "left").select(*[docs[c] for c in columns], "__more")
    at = columns.index("text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, more in ((a.as_py(), b.as_py()) for a, b in zip(batch.column(at), batch.column(len(columns)), strict=True)):
                spans = base_spans(text) if text else []
                spans += [(m["kind"], m["s"], m["e"]) for m in more or []]
                texts.append(redacted(text, spans) if spans else text)
            out = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, columns)

    done = ready.mapInArrow(per_batch, schema)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return done.select(*columns)

"""Personal data: rule-based seeds, then contextual patterns bootstrapped from them.

Seeds are matches of the four base rules (e-mail, IPv4, payment card, phone). The words around a seed, as far as they lie in the
CONTEXT_CHARS code points before and after it, make lexical patterns: the last word before it, the last two, either with the shape of the
identifier (9 for digits, A and a for letters), the first word after it, and the words on both sides. Patterns and instances form a
bipartite graph: a pattern's confidence for a kind is the mean score of the distinct instances that it extracts; an instance's score is the
noisy-or of its best pattern that looks before it and its best that looks only behind it, as patterns that look at the same words are no
evidence of their own. Seeds stay at 1 for their kind and 0 for others. After a few rounds, confident patterns with enough distinct seeds add the identifiers they extract that no base rule
saw: words with an `@` or at least four digits, groups of digits with single spaces or hyphens between them being one. What has a kind's form
but was dropped by its base rule (a number of a card's length that fails the checksum) isn't added as that kind. Base spans never go.

Everything is DataFrame functions. Positions are code points, ends exclusive. Regular expressions are written with single-character
loops and look-behinds, so that they need neither deep stacks nor quadratic time on very long runs; what they accept is stated beside
the plain form of each rule.

Defined cases: a null text is empty and has no spans. Rows may repeat; each has its own spans. Null ids stay null. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

KINDS = ("email", "ip", "card", "phone")
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)"
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ where it has 14 digits or more
CARD = r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){13})[0-9](?:[0-9 -](?<![ -][ -]))*(?<=[0-9])"
#: \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: groups of digits, or words with four digits or an @
IDENTIFIER = r"(?<![^ \t-\r])(?:(?=[0-9](?:[ -]?[0-9]){3})[0-9](?:[0-9 -](?<![ -][ -]))*(?<=[0-9])(?![^ \t-\r.,;:!?)])|(?=[^ \t-\r@]*+@|(?:[^ \t-\r0-9]*+[0-9]){4})[^ \t-\r]++)"
CONTEXT_CHARS = 64
_SPANS = "array<struct<start:int,end:int,hit:string,gap:string,after:string>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def spans_of(text: str, pattern: str) -> str:
    """SQL for all leftmost non-overlapping matches: their places and, as `gap` and `after`, the CONTEXT_CHARS code points before and after them.

    Places are running sums of lengths, taken in blocks of 256 matches, so that arrays which grow stay short. The text around a match is
    put together from the matches next to it and what lies between them, so that long texts of many matches are not cut up again and again;
    so many matches hold CONTEXT_CHARS code points or reach to the text's ends, as a match has two code points at least.
    """
    near = f"array_join(transform(slice(y, greatest(1, i + 1 - {CONTEXT_CHARS // 2}), least(i, {CONTEXT_CHARS // 2})), v -> v.both), '')"
    cut = f"named_struct('lead', right(g, {CONTEXT_CHARS}), 'both', right(concat(right(g, {CONTEXT_CHARS}), h), {CONTEXT_CHARS}), 'fore', left(concat(left(g, {CONTEXT_CHARS}), h), {CONTEXT_CHARS}), 'skip', char_length(g), 'hit', h)"
    pieces = f"zip_with(slice(p, 1, size(f)), f, (g, h) -> {cut})"
    follows = f"concat(transform(y, v -> v.fore), array(left(element_at(p, -1), {CONTEXT_CHARS})))"
    around = f"named_struct('gap', right(concat({near}, x.lead), {CONTEXT_CHARS}), 'after', left(array_join(slice(w, i + 2, {CONTEXT_CHARS // 2 + 1}), ''), {CONTEXT_CHARS}), 'skip', x.skip, 'hit', x.hit)"
    hits = _let("p", f"split({text}, {_literal(pattern)}, -1)", _let("y", pieces, _let("w", follows, f"transform(y, (x, i) -> {around})")))
    block = f"""aggregate(slice(z, 256 * i + 1, 256), named_struct('at', 0, 'out', cast(array() as {_SPANS})),
        (s, x) -> named_struct('at', s.at + x.skip + char_length(x.hit), 'out',
            concat(s.out, cast(array(named_struct('start', s.at + x.skip, 'end', s.at + x.skip + char_length(x.hit), 'hit', x.hit, 'gap', x.gap, 'after', x.after)) as {_SPANS}))))"""
    blocks = f"transform(sequence(0, size(z) div 256), i -> {block})"
    before = "aggregate(k, named_struct('at', 0, 'out', cast(array() as array<int>)), (s, x) -> named_struct('at', s.at + x.at, 'out', concat(s.out, array(s.at))), s -> s.out)"
    moved = f"flatten(zip_with(k, {before}, (b, o) -> transform(b.out, x -> named_struct('start', x.start + o, 'end', x.end + o, 'hit', x.hit, 'gap', x.gap, 'after', x.after))))"
    return _let("f", f"regexp_extract_all({text}, {_literal(pattern)}, 0)", _let("z", hits, _let("k", blocks, moved)))


_DIGITS = "regexp_replace(x.hit, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(sequence(1, char_length({_DIGITS})), i -> cast(substr(reverse({_DIGITS}), i, 1) as int) * (2 - i % 2)), 0L, (s, d) -> s + d div 10 + d % 10) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(transform(split(x.hit, '[.]'), p -> ltrim('0', p)), p -> char_length(p) <= 3 and (p = '' or cast(p as int) <= 255))",
    "card": f"char_length({_DIGITS}) between 14 and 19 and {_LUHN}",
    "phone": f"char_length({_DIGITS}) between 10 and 15",
}
#: The kind whose form an identifier has as a whole. One that the base rules dropped all the same is of another kind, or none, whatever stands around it.
_FORM = f"""case when rlike(hit, {_literal("^[0-9](?:[ -]?[0-9])+$")}) and char_length(regexp_replace(hit, '[^0-9]', '')) between 14 and 19 then {KINDS.index("card")}
    when rlike(hit, {_literal(r"^[0-9]+(?:[.][0-9]+){3}$")}) then {KINDS.index("ip")} when rlike(hit, {_literal(r"^[+][0-9][ ().0-9-]+[0-9]$")}) then {KINDS.index("phone")} end"""
_GUARD = {
    "email": "contains(__text, '@')",
    "ip": "__digit and rlike(__text, '[0-9][.][0-9]')",
    "card": "__digit and rlike(__text, '[0-9](?:[ -]?[0-9]){13}')",
    "phone": "__digit and contains(__text, '+')",
}


def _context(text: str, last: bool) -> str:
    """The last or first two words of a text that stands next to an identifier, lower-cased, without punctuation around them; words of nothing else don't count."""
    words = f"filter(transform(split({text}, '[ \\\\t-\\\\r]+'), w -> regexp_replace(lower(w), '^[^\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}=:]+$', '')), w -> w <> '')"
    return _let("c", words, "slice(c, greatest(size(c) - 1, 1), 2)" if last else "slice(c, 1, 2)")


def _shape(hit: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(left({hit}, {CONTEXT_CHARS}), '[0-9]', '9'), '[A-Z]', 'A'), '[a-z]', 'a')"


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __base: start, end, kind (its place in KINDS), hit, gap and after (the text before and behind) of each base match."""
    out = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__digit", F.expr("rlike(__text, '[0-9]')"))
    kinds = []
    for n, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        found = f"transform(filter({spans_of('__text', pattern)}, x -> {_VALID[kind]}), x -> named_struct('start', x.start, 'kind', {n}, 'end', x.end, 'hit', x.hit, 'gap', x.gap, 'after', x.after))"
        kinds.append(f"case when {_GUARD[kind]} then {found} else cast(array() as array<struct<start:int,kind:int,end:int,hit:string,gap:string,after:string>>) end")
    return out.withColumn("__base", F.expr(f"concat({', '.join(kinds)})"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """__seen: every base match and every other identifier of a text, with its patterns."""
    around = lambda x, hit: f"'words', {_context(x + '.gap', True)}, 'after', {_context(x + '.after', False)}, 'shape', {_shape(hit)}"
    seeds = f"transform(__base, x -> named_struct('start', x.start, 'end', x.end, 'hit', x.hit, 'kind', x.kind, {around('x', 'x.hit')}))"
    lead = "(char_length(t.hit) - char_length(ltrim('(<[\"', t.hit)))"
    hit = "rtrim('.,;:!?)>]\"', ltrim('(<[\"', t.hit))"
    tokens = f"transform({spans_of('__text', IDENTIFIER)}, t -> named_struct('start', t.start + {lead}, 'end', t.start + {lead} + char_length({hit}), 'hit', {hit}, 'kind', cast(null as int), {around('t', hit)}))"
    unseen = f"filter({tokens}, t -> char_length(t.hit) >= 6 and (contains(t.hit, '@') or char_length(regexp_replace(t.hit, '[^0-9]', '')) >= 4) and not exists(flatten(slice(m, t.start div 4096 + 1, (t.end - 1) div 4096 - t.start div 4096 + 1)), b -> b.start < t.end and t.start < b.end))"
    by_place = "transform(sequence(0, char_length(__text) div 4096), i -> filter(__base, b -> b.start < 4096 * (i + 1) and b.end > 4096 * i))"
    unseen = _let("m", by_place, unseen)
    kind = "array<struct<start:int,end:int,hit:string,kind:int,words:array<string>,after:array<string>,shape:string>>"
    return docs.withColumn("__seen", F.expr(f"case when __digit or contains(__text, '@') then concat(cast({seeds} as {kind}), cast({unseen} as {kind})) else cast(array() as {kind}) end"))


def _patterns(words: Column, after: Column, shape: Column) -> Column:
    """Patterns that an occurrence has; their first letter says what they look at."""
    last, both, following = F.try_element_at(words, F.lit(-1)), F.when(F.size(words) > 1, F.array_join(words, " ")), F.try_element_at(after, F.lit(1))
    mark = lambda kind, *parts: F.concat(F.lit(f"{kind} "), *(x for k, p in enumerate(parts) for x in ((F.lit(" _ "), p) if k else (p,))))
    return F.filter(F.array(mark("l", last), mark("l", both), mark("s", last, shape), mark("s", both, shape), mark("b", last, following), mark("r", following)), lambda p: p.isNotNull())


def accepted(seen: DataFrame, rounds: int, confidence: float, min_seeds: int) -> tuple[DataFrame, DataFrame]:
    """Confident (pattern, kind) and trusted (hit, kind) from rows of (pattern, hit, kind); kind is null for an identifier that no base rule matched."""
    edges = seen.groupBy("pattern", "hit").agg(F.max("kind").alias("seed"))
    support = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    edges = written(edges.join(support.select("pattern").distinct(), "pattern", "left_semi"))
    seeds = edges.filter("seed is not null").groupBy("hit", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    extracted = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    support = written(support.join(extracted, "pattern"))
    unseen, scores = edges.filter("seed is null").select("pattern", "hit", F.expr(_FORM).alias("form")), seeds
    for k in range(rounds):
        gathered = edges.join(scores, "hit").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        trust = written(support.join(gathered, ["pattern", "kind"]).select("pattern", "kind", (F.col("score") / F.col("instances")).alias("trust")))
        best = unseen.join(trust, "pattern").filter("form is null or form <> kind").groupBy("hit", "kind", F.col("pattern").startswith("r ").alias("behind")).agg(F.max("trust").alias("trust"))
        found = best.groupBy("hit", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))).alias("score"))
        scores = written(seeds.union(found))
    return trust.filter(F.col("trust") >= confidence).select("pattern", "kind"), found.filter(F.col("score") >= confidence).select("hit", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confidence: float = 0.8, min_seeds: int = 5) -> DataFrame:
    """doc_id, base and added for each row of docs: arrays of (start, kind, end), kind being a place in KINDS, by start and kind."""
    key = F.unhex(F.md5(F.concat_ws("\0", id_col, "__text")))
    slim = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    table = written(_occurrences(base_spans(docs.select(id_col, text_col), text_col)).select(F.col(id_col).alias("doc_id"), key.alias("key"), slim(F.col("__base")).alias("base"), F.col("__seen").alias("seen")))
    seen = table.select("key", F.explode("seen").alias("s")).select("key", "s.start", "s.end", "s.hit", "s.kind", F.explode(_patterns(F.col("s.words"), F.col("s.after"), F.col("s.shape"))).alias("pattern"))
    patterns, hits = accepted(seen.select("pattern", "hit", "kind"), rounds, confidence, min_seeds)
    new = seen.filter("kind is null").drop("kind").join(patterns, "pattern").join(hits, ["hit", "kind"])
    added = new.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return table.select("doc_id", "key", "base").join(added, "key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def digests(docs: DataFrame, **how: float) -> DataFrame:
    """doc_id, the number of base spans of each kind, the hash of their list, and the list of all spans."""
    found = find(docs, **how)
    count = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    return found.select("doc_id", *(count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))

"""Grouping of spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so that anagrams have one key, and taking, adding or exchanging
a letter changes it by a value of its own. Two words are near if exactly one inserted, deleted or replaced code point parts them; then
the longer's key less one of its letters' values is the shorter's key (addition and removal), or both keys less a letter's value each
are equal (exchange). So each word is entered once for each of its different letters under its key less that letter, and joined with keys and
with such entries. Where one letter differs, the letters before it or those behind it include a whole half of the word in its order: a hash of
that half is joined on too, so that words that merely are anagrams of each other but for a letter hardly ever meet. What
meets is verified letter by letter with a bounded edit distance.

A word's form is its near word with the largest count (ties: the smallest in code-point order) if that is `factor` times the word's own at
least, its root is where its forms end. Counts double along forms, so a few rounds of pointer doubling find all roots.

Everything is DataFrame expressions. Entries are of different words, not of their occurrences, and go to tasks by hashes of key and
half, so a very frequent word weighs as much as a rare one; occurrences are counted before they are shuffled.

Defined cases: null or empty texts have no words; a null id counts as the empty string where ids matter; rows that repeat an id count
each; an empty table gives an empty one. Code points above 5,404, whose powers don't fit a long, have a hash as value. Words may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import remove, written
from .line_dedup import LOWER, UPPER
from .word_tries import CRC_SQL

#: Sums of letters' values are taken modulo this prime, so that no word is too long.
MODULUS = (1 << 61) - 1
LETTERS = r"[A-Za-zÀ-ÿ]+"


def letter_value(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return F.when(c <= 5404, F.pmod(c * c * c * c * c, F.lit(MODULUS))).otherwise(F.pmod(F.xxhash64(letter), F.lit(MODULUS)))


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, x: F.pmod(total + letter_value(x), F.lit(MODULUS)))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thin: int = 97) -> DataFrame:
    """`word` for each run of letters of the texts, A-Z lower-cased. Runs whose hash with the id is divisible by `thin` lack one letter, as a rule that makes misspellings (0: none do)."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("r"))
    low = runs.select("i", F.translate("r", UPPER, LOWER).alias("w"))
    if not thin:
        return low.select(F.col("w").alias("word"))
    hashed = low.select("w", F.crc32(F.concat("i", F.lit(":"), "w")).alias("h"))
    cut = F.expr("concat(substring(w, 1, cast(h % char_length(w) as int)), substring(w, cast(h % char_length(w) as int) + 2))")
    return hashed.select(F.when(F.col("h") % thin == 0, cut).otherwise(F.col("w")).alias("word"))


def counted(words: DataFrame, min_chars: int = 5, min_n: int = 3) -> DataFrame:
    """word and n for the words (column word) of at least min_chars code points that come min_n times."""
    return words.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_n)


def near_pairs(words: DataFrame) -> DataFrame:
    """a_word, a_n, b_word, b_n: each pair of near words once. words: word and n, each word once."""
    keyed = words.select("word", "n", F.char_length("word").alias("m"), anagram_key(F.col("word")).alias("key"))
    less = keyed.select("word", "n", "m", F.explode(F.transform(F.array_distinct(F.split("word", "")), lambda x: F.pmod(F.col("key") - letter_value(x), F.lit(MODULUS)))).alias("key"))

    def halved(rows: DataFrame, own: str, kept: str, prefix: str) -> DataFrame:
        """Two rows for each: one with a hash of the first half (of `kept` letters), one of the rest of them at the word's end. own: what else must agree."""
        head, tail = f"left(word, int({kept} div 2))", f"right(word, int({kept} - {kept} div 2))"
        halves = F.array(F.struct(F.lit(True).alias("first"), F.expr(head).alias("half")), F.struct(F.lit(False).alias("first"), F.expr(tail).alias("half")))
        rows = rows.select("word", "n", "key", F.expr(head).alias("head"), F.explode(halves).alias("h"))
        return rows.select("key", F.xxhash64(F.lit(own), "h.first", "h.half").alias("half"), F.col("h.first").alias("first"), *(F.col(c).alias(prefix + c) for c in ("word", "n", "head")))

    one_less = halved(less, "one less", "(m - 1)", "a_")
    whole = halved(keyed, "one less", "m", "b_").drop("first")
    removed = one_less.join(whole, ["key", "half"])
    changed = halved(less, "exchanged", "m", "a_")
    exchanged = changed.join(halved(less, "exchanged", "m", "b_").drop("first"), ["key", "half"]).filter("a_word < b_word")
    # a pair that agrees in both halves has met twice: the first half counts
    both = removed.unionByName(exchanged).filter("first or a_head <> b_head")
    return both.filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a_word", "a_n", "b_word", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for rows of word and form: where the forms of a word end. Forms must not run in circles."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.filter("moved").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        remove(now)
        now = new
    return now.drop("moved")


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n)."""
    words = written(words.select("word", "n"))
    pairs = near_pairs(words)
    ends = F.explode(F.array(F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("k")), F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("k"))))
    best = pairs.select(ends.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("minus"), "near")).alias("best"))
    strong = -F.col("best.minus") >= factor * F.col("n")
    found = words.join(best, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    found = written(found)
    ended = roots(found.filter("form is not null"))
    return found.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_n: int = 3, thin: int = 97, factor: int = 2) -> DataFrame:
    """The words of whole texts with their forms and roots; see occurrences, counted and group_variants."""
    return group_variants(counted(occurrences(docs, id_col, text_col, thin), min_chars, min_n), factor)


#: Near words by what is left when the letter at each place goes, without keys.
SQL = (
    r"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') || ':' as i, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from documents
), crc_words as (select distinct i || r as w from runs),
"""
    + CRC_SQL
    + r""", cut as (
  select case when crc % 97 = 0 then substr(r, 1, (crc % length(r))::int) || substr(r, (crc % length(r))::int + 2) else r end as word
  from runs join crcs on w = i || r
), words as (select word, count(*) as n from cut where length(word) >= 5 group by word having count(*) >= 3),
less as (select word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) as rest from (select word, n, unnest(generate_series(1, length(word))) as pos from words)),
near as (
  select distinct a.word, b.word as near, b.n as k from less a join less b on a.pos = b.pos and a.rest = b.rest and a.word <> b.word
  union select l.word, s.word, s.n from less l join words s on l.rest = s.word
  union select s.word, l.word, l.n from less l join words s on l.rest = s.word
), best as (
  select word, count(*) as n_near, first(near order by k desc, near) as near, max(k) as k from near group by word
), formed as (
  select word, case when k >= 2 * n then near end as form, n, coalesce(n_near, 0) as n_near, case when k >= 2 * n then k end as form_n from words left join best using (word)
), chain as (
  select word, word as at from formed union all select c.word, f.form from chain c join formed f on f.word = c.at where f.form is not null
), ends as (select c.word, c.at as root from chain c join formed f on f.word = c.at where f.form is null)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""
)

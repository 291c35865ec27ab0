"""Terms, shingles and similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stopwords import BREAKS, EVERY

# Scripts without spaces between words, and words that are no index terms.
CJK = r"\x{3005}\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}\x{20000}-\x{2FFFF}"
STOP = ("the", "and", "for", "with", "that", "this", "from", "https", "http", "com")
SHORT_STOP = ("an", "as", "at", "be", "by", "do", "go", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we")
POSITIVE = ("love", "excellent", "great", "happy", "good")
NEGATIVE = ("hate", "awful", "bad", "broken", "terrible")
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def bound(x, f) -> Column:
    """f(x) with x computed once a row, however often f names it."""
    return F.get(F.transform(F.array(_c(x)), f), F.lit(0))


def folded(x) -> Column:
    """Full-width letters as ASCII, in lower case."""
    x = _c(x)
    return F.lower(F.when(x.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), F.translate(x, WIDE, NARROW)).otherwise(x))


def words(x) -> Column:
    """Alphanumeric runs without the scripts of CJK, in order."""
    return F.regexp_extract_all(folded(x), F.lit(rf"[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))


def has_cjk(x) -> Column:
    """Whether a text has scripts of CJK; most have no character from U+1100 on, which is told faster."""
    return _c(x).rlike(r"[\x{1100}-\x{10FFFF}]") & _c(x).rlike(f"[{CJK}]")


def long_words(x) -> Column:
    """Distinct words of three characters and more but for STOP. The lengths are left to the expression, which is compiled,
    as functions of array elements are not."""
    runs = lambda t, chars: F.regexp_extract_all(t, F.lit(f"{chars}{{3,}}"), F.lit(0))
    far = rf"[\p{{L}}\p{{N}}&&[^{CJK}]]"
    found = bound(x, lambda t: F.when(t.rlike(r"[\x{1100}-\x{10FFFF}]"), runs(folded(t), far)).otherwise(runs(F.lower(t), r"[\p{L}\p{N}]")))
    return F.array_except(found, F.array(*map(F.lit, STOP)))


def cjk_bigrams(x) -> Column:
    runs = F.regexp_extract_all(folded(x), F.lit(rf"[{CJK}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(r) - 1)), lambda i: r.substr(i, F.lit(2)))))
    return F.when(_c(x).rlike(rf"[{CJK}]"), F.flatten(pairs)).otherwise(F.array().cast("array<string>"))


def terms(x) -> Column:
    """Sorted index terms: words of three letters and more but for stop words, and CJK bigrams."""
    return F.sort_array(F.when(has_cjk(x), F.array_union(long_words(x), cjk_bigrams(x))).otherwise(long_words(x)))


def short_words(x) -> Column:
    return F.array_distinct(F.filter(words(x), lambda w: (F.char_length(w) == 2) & ~w.isin(*SHORT_STOP)))


def mentions(query: str, x) -> Column:
    """Whether all terms and two-letter words of a query are among a text's, and its CJK runs stand in it as written."""
    q = F.lit(query)
    runs = F.regexp_extract_all(folded(q), F.lit(rf"[{CJK}]+"), F.lit(0))
    named = (F.size(terms(q)) > 0) | (F.size(short_words(q)) > 0)
    held = (F.size(F.array_except(terms(q), terms(x))) == 0) & (F.size(F.array_except(short_words(q), words(x))) == 0)
    return named & held & F.forall(runs, lambda r: F.contains(folded(x), r))


def sentiment(x, language) -> Column:
    """A small rule over English words; other languages are UNKNOWN."""
    t = terms(x)
    pos = F.size(F.array_intersect(t, F.array(*map(F.lit, POSITIVE)))) > 0
    neg = F.size(F.array_intersect(t, F.array(*map(F.lit, NEGATIVE)))) > 0
    english = (_c(language) == "en") | _c(language).startswith("en-")
    return F.when(~F.coalesce(english, F.lit(False)), "UNKNOWN").when(pos & neg, "MIXED").when(pos, "POSITIVE").when(neg, "NEGATIVE").otherwise("NEUTRAL")


def grams(x, n: int) -> Column:
    """Distinct character n-grams; none for a shorter text."""
    x = _c(x)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x) - n + 1)), lambda i: x.substr(i, F.lit(n)))
    return F.when(F.char_length(x) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def copy_normal(x) -> Column:
    """Lower-case words without links, punctuation or differences of spacing."""
    kept = F.filter(F.split(_c(x), r"\s+"), lambda w: ~(F.lower(w).startswith("http") | F.lower(w).startswith("www.") | F.contains(w, F.lit("/"))))
    return F.btrim(F.regexp_replace(F.lower(F.array_join(kept, " ")), r"[^\p{L}\p{N}]+", " "))


def jaccard(a, b) -> Column:
    """Two empty sets are equal."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def normal_exact(x) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_c(x)), r"\s+", " "))


def normal_fuzzy(x) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9' ]", " "), " +", " "))


def entropy(x) -> Column:
    """Shannon bits per character."""
    chars = F.split(_c(x), "")
    n = F.size(chars).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def document_frequency(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df): in how many texts each index term occurs.

    Words are exploded and then filtered, so that nothing is sorted or made distinct within a row; only texts with CJK
    scripts take the second way. An id with several rows counts once.
    """
    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spaced = t.select("id", F.explode(words("text")).alias("term")).where((F.char_length("term") > 2) & ~F.col("term").isin(*STOP))
    pairs = t.where(F.col("text").rlike(rf"[{CJK}]")).select("id", F.explode(cjk_bigrams("text")).alias("term"))
    return spaced.union(pairs).distinct().groupBy("term").agg(F.count("*").alias("df"))


def informative(term: Column, stop: tuple[str, ...] = EVERY) -> Column:
    """Whether a term can say something: no number, hash, image size, hiragana run or stop word."""
    t = _c(term)
    hash_ = (F.octet_length(t) >= 6) & t.rlike("^[0-9A-Fa-f]+$") & t.rlike("[0-9]")
    return ~(t.rlike("^[0-9]+$") | hash_ | t.rlike("^[0-9]+x[0-9]+$") | t.rlike(r"^[\x{3040}-\x{309F}]+$") | t.isin(*STOP, *stop))


#: A bare domain or path: ASCII labels joined by dots, the last of two to six letters.
DOMAIN = r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,6}[,)\]」、。]*(/.*)?$"


#: What any text with a link, handle or bare domain has.
MAY_LINK = r"://|(?:^|\s)(?:www\.|@)|[A-Za-z0-9-]\.[A-Za-z]{2}"


def without_links(x) -> Column:
    """A text's words, joined by one space, but for links, @handles and bare domains. Only texts that may have these are
    looked at word by word."""
    link = lambda w: F.contains(w, F.lit("://")) | w.startswith("www.") | w.startswith("@") | w.rlike(DOMAIN)
    kept = F.array_join(F.filter(F.split(F.btrim(_c(x)), r"\s+"), lambda w: (w != "") & ~link(w)), " ")
    return F.when(_c(x).rlike(MAY_LINK), kept).otherwise(F.btrim(F.regexp_replace(_c(x), r"\s+", " ")))


def content_terms(x) -> Column:
    """Sorted terms of what a text is about: index terms of its words without links, and its CJK runs as words of one
    script. All of them, however many."""

    def found(t: Column) -> Column:
        runs = F.regexp_extract_all(folded(t), F.lit(rf"[{CJK}]+"), F.lit(0))
        return F.when(has_cjk(t), F.array_union(long_words(t), F.flatten(F.transform(runs, script_words)))).otherwise(long_words(t))

    return F.sort_array(bound(without_links(x), found))


def phrase_grams(x, longest: int = 3, stop: tuple[str, ...] = BREAKS) -> Column:
    """Distinct runs of two to `longest` consecutive words of a text without links. Stop words, words of one character or
    with CJK scripts, and any sign but a single space between words break a run."""
    cut = F.concat(F.lit(" "), F.regexp_replace(F.lower(without_links(x)), r"[^\p{IsAlphabetic}\p{N}'-]", " "), F.lit(" "))
    heads: dict[str, list[str]] = {}
    for w in stop:
        heads.setdefault(w[0], []).append(w[1:])
    broken = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(heads.items())) + "|[^ ]|"
    # Between two spaces there is a word or, where signs meet, nothing; what breaks a run becomes a mark.
    mark = lambda t, what: F.regexp_replace(t, f" (?:{what})(?= )", " \x01")
    marked = bound(cut, lambda t: F.when(has_cjk(t), mark(t, f"{broken}|[^ ]*[{CJK}][^ ]*")).otherwise(mark(t, broken)))
    word = r"[^ \x01]++"
    runs = lambda t, n: F.regexp_extract_all(t, F.lit(f" (?=((?:{word} ){{{n - 1}}}{word}) )"), F.lit(1))
    return bound(marked, lambda t: F.array_distinct(F.concat(*[runs(t, n) for n in range(2, longest + 1)])))


def script_words(run: Column) -> Column:
    """Runs of one script of two characters and more, without those of hiragana, which are mostly particles."""
    return F.regexp_extract_all(_c(run), F.lit(r"[\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]{2,}|[\x{3005}\x{3007}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}]{2,}|[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]{2,}"), F.lit(0))


def bracketed_spans(x) -> Column:
    """Distinct texts within 「」, 『』 or 【】 of 2 to 30 characters with a letter or digit, folded, spaces collapsed."""
    spans = F.concat(*[F.regexp_extract_all(_c(x), F.lit(f"{a}([^{b}]*){b}"), F.lit(1)) for a, b in ("「」", "『』", "【】")])
    neat = F.transform(spans, lambda s: F.btrim(F.regexp_replace(folded(s), r"\s+", " ")))
    held = F.array_distinct(F.filter(neat, lambda s: F.char_length(s).between(2, 30) & s.rlike(r"[\p{L}\p{N}]")))
    return F.when(~_c(x).rlike("[「『【]"), F.array().cast("array<string>")).otherwise(held)


def name_holds(name, query: str) -> Column:
    """Whether a name has the words of a query as words, in order; a query with CJK scripts as written, spaces aside."""
    import re

    if re.search(r"[\u3005\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\u1100-\u11ff\u3130-\u318f\uac00-\ud7af]", query):
        return F.contains(F.regexp_replace(F.lower(_c(name)), r"\s+", ""), F.lit("".join(query.split()).lower()))
    asked = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    held = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(_c(name)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return F.contains(held, F.lit(f" {' '.join(asked)} ")) if asked else F.lit(False)

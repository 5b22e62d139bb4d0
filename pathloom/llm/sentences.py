"""Sentence boundaries across languages and scripts, in SQL expressions only.

Marks that end no sentence (decimals, hosts and URLs, initials, abbreviations, ordinals, item numbers,
everything inside quotations and brackets) are masked with private-use placeholders of the same length, so
that positions hold; the text is then split by terminator patterns of its scripts, and restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.net import let

# Sentence-ending marks and their placeholders.
MARKS = ".!?…。！？｡।؟"
MASKS = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
BLOCK, END, OTHER = "\ue00d", "\ue00e", "\ue010"
# White space.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PRIVATE = "[\ue000-\ue00f]"
ODD_LINE_END = "\r(?!\n)|[\u2028\u2029\x0b\x0c\x85]"
ODD = "[\r\u2028\u2029\x0b\x0c\x85\ue000-\ue00f]"  # all that these and PRIVATE can begin with

# Abbreviations that never end a sentence by themselves. A blank between two parts may be left out.
NEVER_LAST = (
    "Mr Mrs Ms Dr Prof St Mt Sr Sra Ing Mme Mlle Gen Col Rev Hon Dept Fig Figs Abb Abschn Tab "
    "approx incl excl cf vs viz al ca vgl bzw ggf inkl zzgl sog evtl env aprox ej ex resp EE См см напр рис ок стр ул тел डॉ क्र सं श्री د"
).split() + ["e. g", "i. e", "z. B", "d. h", "u. a", "i. d. R", "o. g", "p. ej", "p. ex", "c.-à-d", "т. е"]
# Abbreviations that end no sentence before a number.
BEFORE_NUMBER = (
    "No Nos no nos Nr nr Num num núm pág págs p pp art arts Art sec Sec secs ch Ch vol Vol Bd S Kap Max Min max min rev Rev ver Ver cap Cap "
    "fig figs tab app App par para Eq eq Ref ref Tel tel Ext ext Abs Ziff п пп гл разд Jan Feb Mar Apr May Jun Jul Aug Sep Sept Oct Nov Dec"
).split()
# Words after a German ordinal number, and words before one.
AFTER_ORDINAL = (
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Mal Tag Woche Monat Quartal Jahr Jahrhundert"
).split()
BEFORE_ORDINAL = "der die das dem den des Der Die Das Dem Den Des the The".split()
# Words that begin a sentence after a single capital letter, which is then no initial.
AFTER_LETTER = "The Then This That These There It He She We They You In On At After Before But And A An No Nothing If When".split()

_OPEN_BRACKET, _CLOSE_BRACKET = "（(\\[【", "）)\\]】"
_OPEN_QUOTE, _CLOSE_QUOTE = "«„「『《‹", "»”」』》›"
_OPEN, _CLOSE = _OPEN_QUOTE + _OPEN_BRACKET, _CLOSE_QUOTE + _CLOSE_BRACKET
# White space, also what a pattern's own class leaves out.
_WS = r"[\s\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_LETTER = r"\p{L}\p{N}"
_ITEM = r"[ \t]*[-*•‣–—][ \t]+\S"
_NUMBERED = r"[ \t]*[0-9]{1,3}[.)][ \t]+\S"
_ENTRY = (
    r"[ \t]*(?:\[[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\]|\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"
    r"|[0-9]{9,10}(?:\.[0-9]+)? \S+:|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ 0-9][0-9] [0-9]{2}:[0-9]{2}:[0-9]{2} )"
)


SEPARATOR = "\ue00f"
# All letters of scripts without case, and the marks of such scripts; not the placeholders.
CASELESS = "[\u0590-\u1c7f\u2e80-\ud7ff\uf900-\uffef]"


def _words(words: list[str]) -> str:
    return "|".join(sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True))


def _after(words: list[str]) -> str:
    """Looks behind a dot for one of the words. A group for each length: each first tests the place before
    the word, so that a word of another length costs one step."""
    spelt = {v for w in words for v in (w, w.replace(". ", "."))}
    by_length = [sorted(w for w in spelt if len(w) == n) for n in sorted({len(w) for w in spelt})]
    return "(?:" + "|".join(rf"(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_words(same)})\.)" for same in by_length) + ")"


def _within() -> str:
    """A dot within an abbreviation of several words."""
    heads = {(w[: i], w[i + 1 :].lstrip()) for w in NEVER_LAST for i in range(len(w)) if w[i] == "."}
    return "|".join(rf"(?={' ?' if ' ' not in tail[:1] else ''}{_words([tail.split('.')[0]])}\.){_after([head])}" for head, tail in sorted(heads))


def _pieces(text: Column, opening: str, closing: str) -> Column:
    """The text cut before each opening and after each closing mark."""
    cut = F.regexp_replace(F.regexp_replace(text, f"([{opening}])", f"{SEPARATOR}$1"), f"([{closing}])", f"$1{SEPARATOR}")
    return F.split(cut, SEPARATOR)


def starts(lengths: Column, width: int = 256) -> Column:
    """Running sums before each element. By strips of `width`, so that the work is not quadratic in a long array."""
    strips = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / width).cast("int")), lambda i: F.slice(lengths, i * width + 1, F.lit(width))
    )
    total = lambda strip: F.aggregate(strip, F.lit(0), lambda a, x: a + x)

    def run(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s.at + x).alias("at"), F.concat(s.out, F.array(s.at)).alias("out"))
        return F.aggregate(values, begin, step, lambda s: s.out)

    bases = run(F.transform(strips, total), F.lit(0))
    return F.flatten(F.zip_with(strips, bases, run))


def _blocks(text: Column) -> Column:
    """The text, a line end before and after it, with a marker for each line end that ends a sentence."""
    # one class decides whether there is anything odd at all
    exact = F.regexp_replace(F.regexp_replace(text, ODD_LINE_END, "\n"), PRIVATE, OTHER)
    lines = F.concat(F.lit("\n"), F.when(text.rlike(ODD), exact).otherwise(text), F.lit("\n"))
    # lines without letter or digit, and the line ends around them
    blank = F.regexp_replace(lines, f"\n([^{_LETTER}]*)\n", f"{BLOCK}$1{BLOCK}")
    return F.regexp_replace(blank, f"\n(?={_ITEM}|{_ENTRY})", BLOCK)


def _numbered(block: Column) -> Column:
    """Splits lists with numbers: a wrapped line may begin with a number, so the block must begin a list."""
    starts_list = block.rlike(f"^{_NUMBERED}") | block.rlike(r"(?s)\n[ \t]*1[.)][ \t]+\S.*\n[ \t]*2[.)][ \t]+\S")
    return F.split(F.when(starts_list, F.regexp_replace(block, f"\n(?={_NUMBERED})", BLOCK)).otherwise(block), BLOCK)


def _mask_pairs(block: Column) -> Column:
    """Masks the marks inside brackets and quotations, but for those right before the closing mark."""

    def hidden(x: Column) -> Column:
        body = F.rtrim(x, F.lit(MARKS))
        return F.concat(F.translate(body, MARKS, MASKS), F.substr(x, F.length(body) + 1))

    def straight(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), hidden(x)).otherwise(x)), '"')

    def paired(text: Column, opening: str, closing: str) -> Column:
        body = lambda x: F.concat(F.left(x, F.lit(1)), hidden(F.substr(x, F.lit(2), F.length(x) - 2)), F.right(x, F.lit(1)))
        whole = lambda x: F.left(x, F.lit(1)).isin(*opening.replace("\\", "")) & F.right(x, F.lit(1)).isin(*closing.replace("\\", ""))
        return F.array_join(F.transform(_pieces(text, opening, closing), lambda x: F.when(whole(x), body(x)).otherwise(x)), "")

    def quoted(plain: Column) -> Column:
        german, other = paired(plain, _OPEN_QUOTE, _CLOSE_QUOTE + "“"), paired(plain, _OPEN_QUOTE + "“", _CLOSE_QUOTE)
        return F.when(F.contains(plain, F.lit("„")), german).otherwise(other)

    bracketed = F.when(block.rlike(f"[{_OPEN_BRACKET}]"), paired(block, _OPEN_BRACKET, _CLOSE_BRACKET)).otherwise(block)
    plain = let(bracketed, lambda x: F.when(F.contains(x, F.lit('"')), let(F.split(x, '"'), straight)).otherwise(x))
    return F.when(block.rlike(f'["“{_OPEN}]'), let(plain, lambda x: F.when(x.rlike(f"[“{_OPEN_QUOTE}]"), quoted(x)).otherwise(x))).otherwise(block)


def _mask_names(text: Column) -> Column:
    """Masks all marks inside URLs and file paths; what stands at their end belongs to the sentence."""
    end = r"(?=[.,;:!?)\]}»”\"'’]*(?:[\s。、，；！？]|\z))"
    url, path = r"(?:https?|ftp|rsync|file)://[^\s\"<>«»„“”。、，；！？]+?", r"(?<![^\s(\[\"'=:])[~.]{0,2}/[\w.~-]+(?:/[\w.~-]*?)*?"
    parts = F.split(F.regexp_replace(text, f"({url}|{path}){end}", f"{SEPARATOR}$1{SEPARATOR}"), SEPARATOR)
    masked = let(parts, lambda p: F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 1, F.translate(x, MARKS, MASKS)).otherwise(x)), ""))
    return F.when(F.contains(text, F.lit("://")) | text.rlike(r"(?<!\S)[~.]{0,2}/\w"), masked).otherwise(text)


def _masked(block: Column) -> Column:
    text = let(_mask_pairs(block), _mask_names)
    text = F.regexp_replace(text, r"^(\s*[0-9]{1,3})\.(?=[\s\xa0])", f"$1{MASKS[0]}")  # the item's number
    # one pass over the dots; what follows is tested before what stands before, as that takes one step
    no_end = [
        r"(?=[\p{Ll}\p{N}])(?<=[\p{L}\p{M}\p{N}]\.)",  # decimals, hosts, versions
        f"(?={_WS}*\\p{{N}})" + _after(BEFORE_NUMBER),
        f"(?={_WS}*\\S)" + _after(NEVER_LAST),
        _within(),
        rf"(?={_WS}*\p{{Lu}})(?!{_WS}+(?:{_words(AFTER_LETTER)})(?!\p{{L}}))(?<=(?<![\p{{L}}\p{{M}}\p{{N}}.\ue000])\p{{Lu}}\.)",  # initials
        rf"(?={_WS}+(?:{_words(AFTER_ORDINAL)})(?!\p{{L}}))(?<=(?<![\p{{L}}\p{{N}}.,])[0-9]{{1,2}}\.)",
        rf"(?={_WS}+\p{{Lu}})(?<=(?<!\p{{L}})(?:{_words(BEFORE_ORDINAL)})[ \n][0-9]{{1,2}}\.)",
    ]
    return F.regexp_replace(text, rf"\.(?:{'|'.join(no_end)})", MASKS[0])


def _ended(text: Column) -> Column:
    """Puts a marker at each sentence end."""
    quote_close = "\"»”“」』》›’'"
    close = f"[{quote_close}{_CLOSE}]"
    opener = f"[\"'“‘¿¡{_OPEN}]"
    # a word with a capital inside and a dotted name keep their small first letter where they begin a sentence
    starter = rf"(?:(?:{opener}[ \xa0\u202f]?)*(?:\p{{Lu}}|\p{{Lt}}|\p{{Lo}}|\p{{N}}|\p{{Ll}}{{1,2}}\p{{Lu}}|[a-z0-9]+(?:\ue000[a-z0-9]+)+))"
    # with the blank left out: a capital must follow; after a word with a capital (Node.JS) not several of them
    tight = (
        rf"(?={opener}?\p{{Lu}})(?:(?<=[\p{{N}}%)\]\"”»][.!?]{{1,3}})(?={opener}?.[\p{{L}}'’ ])|(?<=\p{{Ll}}[.!?]{{1,3}})(?={opener}?.[\p{{Ll}}'’ ])"
        rf"|(?<=(?<!\p{{L}})\p{{Ll}}{{2,30}}[.!?]{{1,3}}))"
    )
    cased = F.regexp_replace(text, rf"([.!?…؟]+(?:[ \xa0\u202f]?{close})*)(?:(?={_WS}+{starter})|{tight})", f"$1{END}")

    def caseless(x: Column) -> Column:
        # Thai: a blank between two Thai letters
        x = F.when(x.rlike("[ก-๎]"), F.regexp_replace(x, r"(?<=[ก-๎])(?=[^\S\n]+[ก-๎])", END)).otherwise(x)
        # the blank left out; and before a word of another script
        x = F.regexp_replace(x, r"([.!?؟])(?<=[\p{Lo}\p{M}\p{N}&&[^฀-๿]][.!?؟])([.!?؟]*)(?:(?=[\p{Lo}&&[^฀-๿]])|(?<![.\p{N}][!?؟]{1,3})(?<![.])(?=" + _WS + r"+\p{Ll}))", f"$1$2{END}")
        # full-width marks and dandas end a sentence whatever follows, but not right before a closing quote
        return F.regexp_replace(x, rf"([。！？｡।॥۔]+[！？!?]*)([)）】]*)(?![！？!?。{END}\"'”’」』》)）】]|{_WS}*$)", f"$1$2{END}")

    return F.when(text.rlike(CASELESS), let(cased, caseless)).otherwise(cased)


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The sentences of each document: key, `start_pos`, `end_pos` (code points from 0, end exclusive) and `sentence`.

    A blank line or a line without letter or digit ends a sentence, a line break alone does not unless a
    list item or log entry follows; its mark belongs to its first sentence. Sentences have no white space
    at either end; what has neither letter nor digit is none. Null, empty and blank texts have none. All
    columns but the key are left out, so names cannot clash. Work is by document and block of lines, without
    a shuffle.
    """
    # a text that holds placeholders of its own, or odd line ends, is restored from itself
    itself = F.when(F.col(text).rlike(ODD), F.col(text)).alias("_text")
    own = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias(key), _blocks(F.col(text)).alias("_marked"), itself)

    def placed(df: DataFrame, parts: Column, base: Column, keep: list[str]) -> DataFrame:
        """A row for each part with its position; one mark stands between two parts. The arrays are never
        empty; explode would infer a filter on them, which works the expressions out a second time."""
        df = df.withColumn("_parts", parts).withColumn("_at", starts(F.transform("_parts", lambda x: F.length(x) + 1)))
        return df.select(*keep, F.explode_outer(F.arrays_zip("_parts", "_at")).alias("_p"), base.alias("_base")).select(
            *keep, F.col("_p._parts").alias("_block"), (F.col("_p._at") + F.col("_base")).alias("_from")
        )

    # the line end put before the text makes positions one less
    rough = placed(own, F.split("_marked", BLOCK), F.lit(-1), [key, "_text"])
    fine = placed(rough.select(key, "_text", F.col("_block").alias("_rough"), F.col("_from").alias("_b")), _numbered(F.col("_rough")), F.col("_b"), [key, "_text"])
    fine = fine.filter(F.col("_block").rlike(f"[{_LETTER}]"))
    ended = fine.withColumn("_masked", _masked(F.col("_block"))).withColumn("_parts", F.split(_ended(F.col("_masked")), END))
    ended = ended.withColumn("_at", starts(F.transform("_parts", F.length)))
    units = ended.select(key, F.explode_outer(F.arrays_zip("_parts", "_at")).alias("_p"), "_from", "_text")
    units = units.select(key, F.col("_p._parts").alias("_part"), (F.col("_p._at") + F.col("_from")).alias("_at"), "_text").filter(F.col("_part").rlike(f"[{_LETTER}]"))
    units = units.withColumn("_bare", F.ltrim("_part", F.lit(SPACES)))
    units = units.withColumns({"start_pos": F.col("_at") + F.length("_part") - F.length("_bare"), "_unit": F.rtrim("_bare", F.lit(SPACES))})
    restored = F.when(F.col("_unit").rlike(PRIVATE), F.translate("_unit", MASKS, MARKS)).otherwise(F.col("_unit"))
    restored = F.when(F.col("_text").isNotNull(), F.substr("_text", F.col("start_pos") + 1, F.length("_unit"))).otherwise(restored)
    return units.select(key, "start_pos", (F.col("start_pos") + F.length("_unit")).alias("end_pos"), restored.alias("sentence"))

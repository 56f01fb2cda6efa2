"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines. A text is cut into lines of a few words, where a new physical line or a sentence begins, before a capitalised word
and before words of some lengths, so a passage that begins or ends inside a sentence, or has neither case nor marks, is
cut alike wherever it stands. In scripts written without spaces lines end after marks, after frequent characters, from
kana to kanji and before leading vowels. Lines are hashed without the white space around them.

A run is a sequence of lines that hold `min_words` words and would not without its first or without its last line. Deleted are the
lines in all runs that stand earlier in the corpus too (documents by doc_id, then by text hash; places in order). Any
longer repeated passage is made of such runs.

Winnowing. A fingerprint is the hash of the first two and the last of the fewest lines from a place on that hold `print_words`
words. Each run selects the least fingerprint inside it, so equal runs have selected equal fingerprints, and neighbouring runs
mostly the same one: it is stored once, as fingerprint, document and line. Where one stands in more than one place of the
corpus, its documents are joined with their places, and the matches are extended both ways: of these documents, and from the
first to the last matched place, all runs that hold a place or lie between two are hashed, and each is looked up among those of
all other places. Nothing is compared with one chosen source, and no group is gathered: counts and first places are combined
before the shuffle.

Words are parted by white space or bars; two characters of Han or kana, or four of Thai, Lao, Khmer or Burmese, count as one
more. Defined cases: null stays null and empty stays empty; rows equal in doc_id and text count as one document and share
its result; null doc_ids come last, told apart by 128 bits of hashes of their texts. An empty table gives no row. Other columns
are kept as they are, whatever their names; one named lines_deleted is replaced. Ids are whole numbers; others need a number
of their own first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: What counts as one line or sentence in lines_deleted.
CUT = r"(?<=[\n ])(?:(?<=\n)|(?<=[.!?] )|(?=\p{Lu}[\p{Ll} ]))"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HAN, INDIC = r"\u3041-\u30ff\u3400-\u9fff", r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
MARKS = r"\u3001\u3002\uff01-\uff1f"
#: A line begins here, behind white space: at a capital, before words of 5 or 7 characters, at a new line or sentence.
STARTS = r"(?:(?=\p{Lu}[\p{Ll} ]|[^%s]{5}(?:[^%s]{2})?(?![^%s]))|%s)"
ANY = SPACE + "|"


# after a mark, from kana to kanji, after a frequent character, before a leading vowel, after some vowel signs
UNSPACED = rf"(?<=[\u0e00-\uffff])(?<=[{HAN}{MARKS}{INDIC}])(?=[^{SPACE}{MARKS}])(?:(?<=[{MARKS}\u104a\u104b\u17d4])|(?<=[\u3041-\u30ff])(?=[\u3400-\u9fff])|(?<=[\u7684\u4e86\u662f\u5728\u4e0d\u6211\u6709\u4eba\u8fd9\u9019\u4e00\u4ed6\u4eec\u5011\u56fd\u570b\u4e2d\u5927])|(?=[\u0e40-\u0e44\u0ec0-\u0ec4])|(?<=[\u1038\u17b6]))"
_ANY = STARTS % (ANY, ANY, ANY, rf"(?<=\n[{ANY}]{{0,3}})|(?<=[.!?][{ANY}]{{1,3}})")
#: Where all white space is single spaces and line feeds these give the same cuts, faster.
_FEW = r"(?:(?=\p{Lu}[\p{Ll} ]|[^ \n]{5}(?:[^ \n]{2})?+(?:[ \n]|\z))|(?<=\n|[.!?\n] ))"
#: The cuts with the white space before them, for bare lines, and without any width.
BARE = {True: rf"[{ANY}]++(?!\z){_ANY}|{UNSPACED}", False: rf"[ \n]++(?!\z){_FEW}"}
WHOLE = {True: rf"(?<=[{ANY}])(?=[^{ANY}]){_ANY}|{UNSPACED}", False: rf"(?<=[ \n])(?=[^ \n]){_FEW}"}
#: A text of characters below U+0E00 alone, without bars and white space other than spaces and line feeds.
EVEN = r"\A[ -{}-\x84\x86-\x9f\xa1-\u0dff\n\x00-\x08\x0e-\x1f]*\z"
#: Lines of a text, in the low bits of what orders fingerprints.
PLACE = (1 << 28) - 1


def _lines(text: Column) -> Column:
    return F.split(text, CUT, -1)


def _body(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def _odd(body: Column) -> Column:
    """Whether there is other white space than single spaces and line feeds, a bar, or a script without spaces."""
    return ~F.rlike(body, F.lit(EVEN)) | F.contains(body, F.lit("  "))


def _cut(body: Column, by: dict[bool, str], odd: Column) -> Column:
    return F.when(odd, F.split(body, by[True], -1)).otherwise(F.split(body, by[False], -1))


def _own(text: Column) -> Column:
    """The lines with the white space behind them, without that before the first."""
    return _cut(_body(text), WHOLE, _odd(_body(text)))


def _pieces(text: Column, own: Column | None = None) -> Column:
    """The lines of a text with the white space behind them; joined, they are the text. own: _own(text), if at hand."""
    own = _own(text) if own is None else own
    lead = F.substring(text, F.lit(1), F.length(text) - F.length(_body(text)))
    return F.concat(F.array(F.concat(lead, F.element_at(own, 1))), F.slice(own, F.lit(2), F.size(own)))


def _words(line: Column) -> Column:
    """Words of a line of a text with odd characters."""
    parts = F.greatest(F.size(F.filter(F.split(line, rf"[{SPACE}|]+"), lambda x: x != "")), F.lit(1))
    more = lambda chars, n: F.floor(F.length(F.regexp_replace(line, f"[^{chars}]", "")) / n).cast("int")
    return parts + F.when(F.rlike(line, F.lit(f"[{HAN}{INDIC}]")), more(HAN, 2) + more(INDIC, 4)).otherwise(0)


def _document(text: Column) -> dict[str, Column]:
    """What tells documents apart, in their order. Without a doc_id a second hash of the text stands for it."""
    return {"none": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)), "tag": F.xxhash64(text)}


DOCUMENT = ["none", "id", "tag"]


def _held(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """keep and one made column, which is computed once, however often it is used."""
    ((name, c),) = made.items()
    return df.select(*keep, F.explode(F.array(c)).alias(name))


def _layout(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, h: hash of each line, at: the line of each word, first: the first word of each line, and their number.

    rows: keep, body. All but keep is null where body is.
    """
    bare = _held(rows, [*keep, "body"], odd=_odd(F.col("body")))
    bare = _held(bare, [*keep, "odd"], p=_cut(F.col("body"), BARE, F.col("odd")))
    last = F.array(F.rtrim(F.element_at("p", -1), F.lit(SPACES)))
    bare = _held(bare, [*keep, "odd"], p=F.concat(F.slice("p", F.lit(1), F.size("p") - 1), last))
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    words = F.when(F.col("odd"), F.transform("p", _words)).otherwise(F.transform("p", lambda x: spaces(x) + 1))
    rows = _held(bare, [*keep, F.transform("p", lambda x: F.xxhash64(x)).alias("h")], w=words)
    rows = _held(rows, [*keep, "h"], at=F.flatten(F.transform("w", lambda n, i: F.array_repeat(i, n))))
    begins = F.transform("at", lambda i, k: F.when(~F.get("at", k - 1).eqNullSafe(i), k))
    return _held(rows, [*keep, "h", "at"], first=F.concat(F.array_compact(begins), F.array(F.size("at"))))


def _from(end: Column, words: int) -> Column:
    """The last line from which on there are so many words up to the end; null where there are fewer."""
    return F.get("at", F.get("first", end) - words)


def _runs(rows: DataFrame, keep: list[str], min_words: int) -> DataFrame:
    """keep, start, end of each run of layouts, a row each: slices of arrays are cheap in rows, but not in higher-order functions."""
    rows = rows.filter(F.size("at") >= min_words)
    rows = rows.select(*keep, "at", "first", F.explode(F.sequence(F.get("at", F.lit(min_words - 1)) + 1, F.size("h"))).alias("end"))
    # the last start of an end, and those before it that the end before can't have
    high = _from(F.col("end"), min_words)
    low = F.least(F.coalesce(_from(F.col("end") - 1, min_words) + 1, F.lit(0)), high)
    return rows.select(*keep, "at", "first", "end", low.alias("low"), F.explode(F.sequence(low, high)).alias("start"))


def _bodies(docs: DataFrame) -> DataFrame:
    """none, id, tag, body of the documents that have one, and doc: a hash of the three."""
    rows = docs.select(*(c.alias(n) for n, c in _document(F.col("text")).items()), _body(F.col("text")).alias("body"))
    return rows.filter("body != ''").withColumn("doc", F.xxhash64(*DOCUMENT))


def fingerprints(docs: DataFrame, min_words: int = 40, print_words: int = 12) -> DataFrame:
    """doc: a hash of the document, chosen: a line at which a fingerprint is selected, print: that fingerprint."""
    if not 0 < print_words <= min_words:
        raise ValueError("a fingerprint has from one to min_words words")
    rows = _layout(_bodies(docs).select("doc", "body"), ["doc"]).filter(F.size("at") >= min_words)
    rows = _held(rows, ["doc", "h", "at", "first"], starts=F.slice("first", F.lit(1), F.get("at", F.size("at") - print_words) + 1))

    def print_at(i: Column, word: Column) -> Column:
        last = F.get("at", word + print_words - 1)
        return F.xxhash64(F.get("h", i), F.get("h", F.least(i + 1, last)), F.get("h", last))

    # the least fingerprint, and of equal ones the first, is the least of these
    order = F.transform("starts", lambda x, i: print_at(i, x).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))
    rows = _held(rows, ["doc", "h", "at", "first"], order=order)
    runs = _runs(rows, ["doc", "h", "order"], min_words)
    least = lambda s, e: F.array_min(F.slice("order", s + 1, _from(e, print_words) - s + 1)).bitwiseAND(F.lit(PLACE)).cast("int")
    start, end, low = F.col("start"), F.col("end"), F.col("low")
    # the least of a sliding window never moves back, so the runs that selected a fingerprint follow one another
    before = F.when(start > low, least(start - 1, end)).when(_from(end - 1, min_words).isNotNull(), least(_from(end - 1, min_words), end - 1))
    runs = runs.select("doc", "h", "at", "first", least(start, end).alias("chosen"), before.alias("before"))
    runs = runs.filter(~F.col("chosen").eqNullSafe(F.col("before")))
    return runs.select("doc", "chosen", print_at(F.col("chosen"), F.get("first", F.col("chosen"))).alias("print"))


def repeated(docs: DataFrame, min_words: int = 40, print_words: int = 12) -> DataFrame:
    """none, id, tag, runs: for each document that repeats something, start and end of its runs that stand earlier too."""
    held = materialize(fingerprints(docs, min_words, print_words), "fingerprints")
    # written, so that both sides of each join are read through a shuffle of their own and a hot key can be split
    place = F.xxhash64("doc", "chosen")
    often = held.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("print")
    often = materialize(often, "often")
    matched = held.join(often, "print").groupBy(F.col("doc").alias("m_doc")).agg(F.min("chosen").alias("since"), F.max("chosen").alias("until"))
    matched = materialize(matched, "matched")
    # out from the matches of a document over all runs that hold one of them or lie between them
    # by a shuffle at all sizes, as a broadcast ends with small tables
    rows = _bodies(docs).join(matched.hint("merge"), F.col("doc") == F.col("m_doc"))
    keep = [*DOCUMENT, "since", "until"]
    runs = _runs(_layout(rows.select(*keep, "body"), keep), [*keep, "h"], min_words)
    runs = runs.filter((F.col("start") <= F.col("until")) & (_from(F.col("end"), print_words) >= F.col("since")))
    lines = F.col("end") - F.col("start")
    # equal runs have as many lines, so a place needs no end; a key differs where their number does
    key = F.xxhash64(lines, F.slice("h", F.col("start") + 1, lines))
    runs = materialize(runs.select(key.alias("key"), *DOCUMENT, "start", lines.alias("lines")), "runs")
    place = F.struct(*DOCUMENT, "start")
    first = runs.groupBy("key").agg(F.min(place).alias("first"), F.min("lines").alias("lines"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.filter("n > 1").select("key", "first", "lines"), "first")
    later = runs.select("key", *DOCUMENT, "start").join(first, "key").filter(place > F.col("first"))
    run = F.struct("start", (F.col("start") + F.col("lines")).alias("end"))
    return later.groupBy(*DOCUMENT).agg(F.collect_list(run).alias("runs"))


def _left(hit: Column) -> Column:
    """The lines [a, b) to keep, without the runs in hit; b of the last is null, the end."""
    # starts and ends both ascend, so a gap is what lies between the end of a run and the start of the next
    places = F.sort_array(hit)
    begin = F.concat(F.array(F.lit(0)), places["end"])
    end = F.concat(places["start"], F.array(F.lit(None).cast("int")))
    gaps = F.zip_with(begin, end, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.filter(gaps, lambda r: r["b"].isNull() | (r["a"] < r["b"]))


def dedup(docs: DataFrame, min_words: int = 40, print_words: int = 12) -> DataFrame:
    """docs with the later repeated runs taken out of text, and a column lines_deleted (int): lines and sentences, and parts of them, taken out."""
    docs = docs.drop("lines_deleted")
    hit = repeated(docs, min_words, print_words).select(*(F.col(c).alias(f"r_{c}") for c in DOCUMENT), F.col("runs").alias("hit"))
    rows = docs.select(F.struct(*docs.columns).alias("d"), *(c.alias(n) for n, c in _document(F.col("text")).items()))
    rows = rows.join(hit, [F.col(c) == F.col(f"r_{c}") for c in DOCUMENT], "left")
    # cut again, where something goes
    rows = _held(rows, ["d"], kept=_left(F.col("hit")))
    rows = _held(rows, ["d", "kept"], own=F.when(F.col("kept").isNotNull(), _own(F.col("d.text"))))
    rows = _held(rows, ["d", "kept"], p=F.when(F.col("kept").isNotNull(), _pieces(F.col("d.text"), F.col("own"))))
    part = lambda a, b: F.array_join(F.slice("p", a + 1, b - a), "")
    left = F.array_join(F.transform("kept", lambda r: part(r["a"], F.coalesce(r["b"], F.size("p")))), "")
    gone = F.transform("kept", lambda r, k: part(F.when(k > 0, F.try_element_at("kept", F.greatest(k, F.lit(1)))["b"]).otherwise(0), r["a"]))
    n = F.aggregate(gone, F.lit(0), lambda s, x: s + F.size(F.filter(_lines(x), lambda y: y != "")))
    rows = _held(rows, ["d"], new=F.when(F.col("kept").isNotNull(), F.struct(left.alias("text"), n.alias("n"))))
    return rows.select(*(F.coalesce("new.text", "d.text").alias("text") if c == "text" else F.col("d")[c].alias(c) for c in docs.columns), F.coalesce("new.n", F.lit(0)).alias("lines_deleted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs are deleted; a document of which nothing is left goes, n_chars follows the text."""
    out = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text")
    out = dedup(out)
    out = out.filter((F.col("lines_deleted") == 0) | (F.trim("text", F.lit(" \n\t\r")) != ""))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("lines_deleted") == 0, F.col("whole.n_chars")).otherwise(F.length("text").cast(kind))
    return out.select(*(changed[c].alias(c) if c in changed else F.col("whole")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's text without later repeated runs."""
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "lines_deleted", "text")

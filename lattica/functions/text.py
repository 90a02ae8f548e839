"""Text functions: tokens, chunks, cleaning, record parsing, answer metrics.

The default tokenizer is a split at white space; token counts and chunks take
any Column of tokens, so another tokenizer can be put in as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 100


def tokens(text: Column) -> Column:
    """The tokens of a text; null gives none."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), " "), "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_chunks(words: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of (chunk, n_tokens) with a stride of size - overlap; the last one can be overlap alone. Without tokens, none."""
    stride = size - overlap
    whole = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / stride).cast("int")), lambda i: F.struct(F.array_join(F.slice(w, i * stride + 1, size), " ").alias("chunk"), F.least(F.lit(size), F.size(w) - i * stride).alias("n_tokens")))
    none = F.array().cast("array<struct<chunk:string,n_tokens:int>>")
    # bound to a variable, the text is split once
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, whole(w)).otherwise(none)), 1)


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, position, chunk, n_tokens, id): text units of each document; the id is the md5 of the chunk."""
    units = docs.select(key, F.posexplode(token_chunks(tokens(F.col(text)), size, overlap)).alias("position", "unit"))
    return units.select(key, "position", "unit.chunk", "unit.n_tokens", F.md5("unit.chunk").alias("id"))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\x0B\f\r]+", "$1\x01"), "\x01"), lambda s: s != "")


def split_text(text: Column, separator: str = ",") -> Column:
    """Null stays null, the empty text gives an empty list."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, f"\\Q{separator}\\E"))


def replace_all(text: Column, pairs: Sequence[tuple[str, str]], regex: bool = False) -> Column:
    """Replacements in turn, literal ones by default."""
    for a, b in pairs:
        text = F.regexp_replace(text, a, b) if regex else F.replace(text, F.lit(a), F.lit(b))
    return text


#: The named entities that are unescaped; numeric ones stay.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def clean_str(text: Column) -> Column:
    """Trimmed, unescaped, without control characters."""
    return F.regexp_replace(replace_all(F.trim(text), ENTITIES), r"[\x00-\x1F\x7F-\x9F]", "")


def clean_unicode(text: Column) -> Column:
    """Without characters beyond Latin-1 letters and common marks; runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x20-\x7E -ɏ]", " "), r" +", " "))


def parse_json(text: Column, schema: str) -> Column:
    """The outermost JSON object of a text, fences and trailing commas removed; null where it can't be read."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)


def extraction_records(text: Column) -> Column:
    """Records of an extraction answer: split at ##, outer parentheses dropped, fields split at <|>."""
    records = F.filter(F.transform(F.split(text, "##"), lambda r: F.trim(F.regexp_replace(F.trim(r), r"^\(|\)$", ""))), lambda r: r != "")
    unquote = lambda f: F.trim(F.regexp_replace(F.trim(f), r'^"|"$', ""))
    return F.transform(records, lambda r: F.transform(F.split(r, r"<\|>"), unquote))


def extracted_graph(answers: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Entities (key, title, type, description) and relationships (key, source, target, description, weight: 1.0 unless a number) of extraction answers."""
    r = answers.select(key, F.explode(extraction_records(F.col(text))).alias("r"))
    field = lambda i: F.get("r", i)
    entities = r.where((field(0) == "entity") & (F.size("r") >= 4)).select(key, F.upper(field(1)).alias("title"), F.upper(field(2)).alias("type"), field(3).alias("description"))
    edges = r.where((field(0) == "relationship") & (F.size("r") >= 5))
    last = F.element_at("r", -1).try_cast("double")
    return entities, edges.select(key, F.upper(field(1)).alias("source"), F.upper(field(2)).alias("target"), field(3).alias("description"), F.coalesce(last, F.lit(1.0)).alias("weight"))


#: The fields of a claim, by place.
CLAIM = ("subject_id", "object_id", "type", "status", "start_date", "end_date", "description", "source_text", "doc_id")


def claims(answers: DataFrame, key: str, text: str) -> DataFrame:
    """One row per claim tuple; missing fields are null."""
    r = answers.select(key, F.explode(extraction_records(F.col(text))).alias("r"))
    return r.select(key, *(F.get("r", i).alias(name) for i, name in enumerate(CLAIM)))


def direct_answer(text: Column) -> Column:
    """What follows `answer:` on its line, without quotes and a final stop; without it, the trimmed text."""
    found = F.regexp_extract(text, r"(?i)answer\s*[:=]\s*([^\n]*)", 1)
    return F.regexp_replace(F.trim(F.when(found != "", found).otherwise(text)), r"""^["']+|["'.]+$""", "")


REPORT = "struct<title:string,summary:string,findings:array<struct<summary:string,explanation:string>>,rating:double,rating_explanation:string>"


def report_of(text: Column) -> Column:
    """A report from a JSON answer: strict if title, summary, findings and rating are there; weak with what there is; a default row otherwise."""
    r = parse_json(text, REPORT)
    findings = F.coalesce(r["findings"], F.array().cast("array<struct<summary:string,explanation:string>>"))
    strict = r["title"].isNotNull() & r["summary"].isNotNull() & r["findings"].isNotNull() & r["rating"].isNotNull()
    state = F.when(strict, "strict").when(r["title"].isNotNull() | r["summary"].isNotNull(), "weak").otherwise("default")
    return F.struct(F.coalesce(r["title"], F.lit("")).alias("title"), F.coalesce(r["summary"], F.lit("")).alias("summary"), findings.alias("findings"), F.coalesce(r["rating"], F.lit(-1.0)).alias("rating"), state.alias("state"))


def level_ratings(text: Column, n: int) -> Column:
    """Ratings of n levels with their mean first; null unless there are n numbers."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(F.size(numbers) == n, F.concat(F.array(mean(numbers)), numbers))


def map_points(text: Column) -> Column:
    """Points of a map answer: description and integer score; points without either are dropped."""
    points = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "struct<points:array<struct<description:string,score:int>>>")["points"]
    return F.filter(F.coalesce(points, F.array().cast("array<struct<description:string,score:int>>")), lambda p: p.description.isNotNull() & p.score.isNotNull())


def report_text(report: Column) -> Column:
    """`# title`, summary, then `## finding` and its explanation."""
    parts = F.transform(report["findings"], lambda f: F.concat(F.lit("## "), F.coalesce(f.summary, F.lit("")), F.lit("\n\n"), F.coalesce(f.explanation, F.lit(""))))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), report["title"]), report["summary"], F.array_join(parts, "\n\n"))


def rank_of(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(-1.0))


def prompt(template: str, **columns: Column) -> Column:
    """Fills {name} places of a template with columns; null is the empty text."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def rows_to_text(df: DataFrame, group: str, order: str, columns: Sequence[str], without: str = "embedding") -> DataFrame:
    """(group, text): a header and one line per row, fields joined by commas; embedding columns are left out."""
    kept = [c for c in columns if without not in c]
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x.l)
    return df.groupBy(group).agg(F.concat(F.lit(",".join(kept) + "\n"), F.array_join(lines, "\n")).alias("text"))


def timestamp_parts(text: Column, pattern: str | None = None) -> dict[str, Column]:
    """year to second of a timestamp or its text; null where it can't be read."""
    at = F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)
    return {p: getattr(F, p)(at) for p in ("year", "month", "dayofmonth", "hour", "minute", "second")}


def typed(df: DataFrame, kinds: dict[str, str], required: bool = True) -> DataFrame:
    """Columns read as types (a mapping of names); a required value that isn't of its type raises, an optional one is null."""
    return df.select(*((F.col(c).cast(k) if required else F.col(c).try_cast(k)).alias(c) for c, k in kinds.items()))


def pack_bits(bits: Column) -> Column:
    """Up to 64 booleans as one long, lowest bit first."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sign_bits(vector: Column, first: int = 0, n: int = 63) -> Column:
    """Sign bits of up to 63 components as a long: set where a component is above 0."""
    return pack_bits(F.transform(F.slice(vector, first + 1, n), lambda x: x > 0))


# ---------------------------------------------------------------- answers


def normalise_answer(text: Column) -> Column:
    """Lower case, without punctuation, articles and extra spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(tokens(plain), lambda w: ~w.isin("a", "an", "the")), " ")


def hit(prediction: Column, answers: Column) -> Column:
    """1 if a normalised answer is part of the normalised prediction."""
    p = normalise_answer(prediction)
    return F.exists(answers, lambda a: p.contains(normalise_answer(a))).cast("int")


def exact_match(prediction: Column, answer: Column) -> Column:
    return (normalise_answer(prediction) == normalise_answer(answer)).cast("int")


def token_scores(rows: DataFrame, key: str, prediction: str, answer: str) -> DataFrame:
    """(key, precision, recall, f1) over the token multisets of two text columns; 0 without a common token.

    Tokens are counted by an aggregation, so long predictions cost no more
    than their length. Keys are unique.
    """
    side = lambda c, i: rows.select(key, F.explode(tokens(normalise_answer(F.col(c)))).alias("w"), F.lit(i).alias("side"))
    counts = side(prediction, 0).unionByName(side(answer, 1)).groupBy(key, "w").agg(F.sum(1 - F.col("side")).alias("p"), F.sum("side").alias("a"))
    sums = counts.groupBy(key).agg(F.sum("p").alias("p"), F.sum("a").alias("a"), F.sum(F.least("p", "a")).alias("same"))
    found = rows.select(key).join(sums, key, "left")
    p, r = (F.coalesce(F.try_divide("same", c), F.lit(0.0)) for c in "pa")
    return found.select(key, p.alias("precision"), r.alias("recall"), F.when(F.col("same") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def set_scores(predictions: Column, answers: Column) -> Column:
    """precision, recall and f1 over sets of normalised answers."""
    p, a = (F.array_distinct(F.transform(x, normalise_answer)) for x in (predictions, answers))
    same = F.size(F.array_intersect(p, a))
    precision, recall = F.when(F.size(p) > 0, same / F.size(p)).otherwise(0.0), F.when(F.size(a) > 0, same / F.size(a)).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), F.when(same > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def graph_answer(prediction: Column, answer: Column) -> Column:
    """1 if the answer's word stands in the prediction (support or counter, for arguments)."""
    return (F.instr(F.lower(prediction), F.lower(answer)) > 0).cast("int")


def bleu(prediction: Column, answer: Column, order: int = 1, smooth: bool = False) -> Column:
    """BLEU of one pair with the brevity penalty; smooth adds one to the counts of orders above 1."""
    a, b = tokens(F.lower(prediction)), tokens(F.lower(answer))
    logs = []
    for n in range(1, order + 1):
        grams = lambda w, n=n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        p, r = grams(a), grams(b)
        count = lambda w, x: F.size(F.filter(w, lambda y: y == x))
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, x: s + F.least(count(p, x), count(r, x)))
        add = 1 if smooth and n > 1 else 0
        logs.append(F.log((same + add) / (F.size(p) + add)))
    mean = sum(logs[1:], logs[0]) / order
    brief = F.when(F.size(a) >= F.size(b), 1.0).otherwise(F.exp(1 - F.size(b) / F.size(a)))
    return F.coalesce(F.when(F.size(a) > 0, brief * F.exp(mean)), F.lit(0.0))


def rouge_l(prediction: Column, answer: Column) -> Column:
    """F1 of the longest common subsequence of tokens, by one row of its table folded over the prediction."""
    a, b = tokens(F.lower(prediction)), tokens(F.lower(answer))
    zero = F.transform(b, lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        # a cell is the diagonal plus one on a match, else the larger of above and left
        each = F.transform(b, lambda y, j: F.when(y == x, F.when(j > 0, F.get(row, j - 1)).otherwise(0) + 1).otherwise(F.get(row, j)))
        return F.aggregate(each, F.array().cast("array<int>"), lambda s, v: F.concat(s, F.array(F.greatest(v, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))))))

    length = F.coalesce(F.try_element_at(F.aggregate(a, zero, step), F.lit(-1)), F.lit(0))
    p, r = length / F.size(a), length / F.size(b)
    return F.when(length > 0, 2 * p * r / (p + r)).otherwise(0.0)


def best_over(answers: Column, score) -> Column:
    """The best score over several references; without any, 0."""
    return F.coalesce(F.array_max(F.transform(answers, score)), F.lit(0.0))


def numbered_questions(text: Column) -> Column:
    """The texts after `Question N:` in an answer."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"Question\s+\d+\s*:\s*([^\n]+)"), 1), lambda q: F.trim(q))

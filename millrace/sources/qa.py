"""Question and answer posts from CSV, their documents and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources import split_csv
from millrace.sources.config import register_adapter


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted multi-line CSV with header, a file by as many tasks as it has ranges; malformed rows are null, not errors.

    ``_row`` orders the rows as they are in the files, files by name.
    """
    return split_csv.read(spark, path)


def post_files(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(question.csv, answer.csv) of a folder or of its ``data`` folder; an error if either is missing.

    Any file system that Spark reads will do.
    """
    names = ("question.csv", "answer.csv")
    for place in (folder.rstrip("/"), folder.rstrip("/") + "/data"):
        paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{n}") for n in names]
        if all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths):
            return f"{place}/{names[0]}", f"{place}/{names[1]}"
    raise FileNotFoundError(f"{' and '.join(names)} are neither in {folder} nor in {folder}/data")


def _order(raw: DataFrame) -> list[str]:
    return ["_row"] if "_row" in raw.columns else []


def _named(df: DataFrame, *names: str) -> Column:
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def list_literal(c: Column) -> Column:
    """The strings of a list literal with single or double quotes; null where it is none.

    Items are read by pattern: an item in one kind of quotes may hold the other
    kind, and escaped characters lose their backslash.  Escaped quotes and
    backslashes are set aside first, so that no pattern has to step over them
    one by one, which long items don't allow.
    """
    aside = (("\\\\", "\ufdd0", "\\"), ("\\'", "\ufdd1", "'"), ('\\"', "\ufdd2", '"'))  # noncharacters, which no text has
    body = F.trim(c)
    plain = body
    for escaped, mark, _ in aside:
        plain = F.replace(plain, F.lit(escaped), F.lit(mark))
    plain = F.regexp_replace(plain, r"(?s)\\(.)", "$1")
    items = F.regexp_extract_all(plain, F.lit(r"""'[^']*+'|"[^"]*+"|[^\s,\[\]'"]++"""), 0)

    def unquoted(x: Column) -> Column:
        quoted = (F.length(x) >= 2) & (F.left(x, F.lit(1)) == F.right(x, F.lit(1))) & F.left(x, F.lit(1)).isin("'", '"')
        out = F.when(quoted, x.substr(F.lit(2), F.length(x) - 2)).otherwise(x)
        for _, mark, meant in aside:
            out = F.replace(out, F.lit(mark), F.lit(meant))
        return out

    return F.when(body.startswith("[") & body.endswith("]"), F.transform(items, unquoted))


def joined_literal(c: Column) -> Column:
    """A list literal's items joined by spaces, any other text as it is."""
    return F.coalesce(F.array_join(list_literal(c), " "), F.trim(c), F.lit(""))


def ids_literal(c: Column) -> Column:
    """Ids of a list literal, a comma-separated list or a single value."""
    plain = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(list_literal(c), plain)


def questions(raw: DataFrame) -> DataFrame:
    """Parsed question rows; ids are q_<id>."""
    return raw.select(
        F.concat(F.lit("q_"), _named(raw, "Question Id", "question_id")).alias("external_id"),
        F.trim(_named(raw, "Question Title", "question_title")).alias("title"),
        joined_literal(_named(raw, "Question Body", "question_body")).alias("body"),
        ids_literal(_named(raw, "Tags", "tags")).alias("tags"),
        F.lit("question").alias("post_type"),
        _named(raw, "Question Type", "question_type").try_cast("int").alias("question_type"),
        ids_literal(_named(raw, "Answer Posts", "answer_posts")).alias("related_posts"),
        F.lit(None).cast("string").alias("summary"),
        *_order(raw),
    )


def answers(raw: DataFrame) -> DataFrame:
    """Parsed answer rows; ids are a_<id>."""
    return raw.select(
        F.concat(F.lit("a_"), _named(raw, "Answer Id", "answer_id")).alias("external_id"),
        F.lit(None).cast("string").alias("title"),
        joined_literal(_named(raw, "Answer Body", "answer_body")).alias("body"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("answer").alias("post_type"),
        F.lit(None).cast("int").alias("question_type"),
        F.array().cast("array<string>").alias("related_posts"),
        joined_literal(_named(raw, "Summary", "summary")).alias("summary"),
        *_order(raw),
    )


def rows(question_rows: DataFrame, answer_rows: DataFrame) -> DataFrame:
    """Questions first, then answers, with an explicit ``_pos``: their order in the files, or by id where that isn't known."""
    both = question_rows.withColumn("_part", F.lit(0)).unionByName(answer_rows.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_pos", F.struct("_part", *_order(both), "external_id"))


def answer_documents(question_rows: DataFrame, answer_rows: DataFrame) -> DataFrame:
    """Answers as documents: body and summary, the question's data beside them; blank answers are left out.

    An answer belongs to the first question that lists it (in the files' order,
    by id where that isn't known), else to the question of its own number.
    """
    place = F.struct(*_order(question_rows), F.col("external_id").alias("id"))
    answer_no = F.regexp_replace("external_id", "^a_", "")
    number = lambda c: F.regexp_replace(c, "^[aq]_", "")
    q = question_rows.select(place.alias("place"), "external_id", "title", F.col("body").alias("context"), "tags", "question_type", "related_posts")
    listed = q.select(F.explode("related_posts").alias("n"), "place", "title", "context", F.col("tags").alias("q_tags"), "question_type").withColumn("n", number(F.col("n")))
    first = listed.groupBy("n").agg(F.min_by(F.struct("title", "context", "q_tags", "question_type"), "place").alias("l"))
    same = q.select(number(F.col("external_id")).alias("n"), F.struct("title", "context", F.col("tags").alias("q_tags"), "question_type").alias("s"))
    found = answer_rows.where(F.trim("body") != "").withColumn("n", answer_no).join(first, "n", "left").join(same, "n", "left")
    own = F.when(F.coalesce(F.col("l.context"), F.lit("")) != "", F.col("l")).otherwise(F.coalesce("s", "l"))
    text = F.concat(F.col("body"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("\n\nSummary: "), F.col("summary"))).otherwise(""))
    found = found.withColumn("own", own)
    return found.select(
        "external_id",
        text.alias("text"),
        F.lit("answer").alias("post_type"),
        F.col("own.title").alias("question_title"),
        F.col("own.context").alias("question_context"),
        (F.coalesce("own.context", F.lit("")) != "").alias("has_question_context"),
        F.coalesce("own.q_tags", F.array().cast("array<string>")).alias("tags"),
        F.col("own.question_type").alias("question_type"),
        (F.coalesce("summary", F.lit("")) != "").alias("has_summary"),
    )


def evaluation_queries(question_rows: DataFrame, documents: DataFrame, shortest: int = 10) -> DataFrame:
    """(query_id, kind, query_text, relevant): from titles, their first six words and first sentences of questions with a stored answer."""
    known = documents.select(F.col("external_id").alias("doc"))
    wanted = question_rows.select("external_id", "title", "body", F.explode("related_posts").alias("p")).withColumn("doc", F.concat(F.lit("a_"), F.regexp_replace("p", "^a_", "")))
    kept = wanted.join(known, "doc", "left_semi").groupBy("external_id", "title", "body").agg(F.array_sort(F.collect_set("doc")).alias("relevant"))
    short = F.array_join(F.slice(F.split(F.trim("title"), r"\s+"), 1, 6), " ")
    sentence = F.trim(F.split_part(F.col("body"), F.lit("."), F.lit(1)))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in (("title", F.trim("title")), ("short", short), ("sentence", sentence))))
    rows = kept.select("external_id", "relevant", F.explode(kinds).alias("k")).where(F.length("k.t") > shortest)
    return rows.select(F.concat_ws(":", "external_id", "k.kind").alias("query_id"), F.col("k.kind").alias("kind"), F.col("k.t").alias("query_text"), "relevant")


def qrels(query_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): every chunk of a relevant document is relevant."""
    return query_rows.select("query_id", F.explode("relevant").alias("external_id")).join(chunks.select("external_id", "chunk_id"), "external_id").select("query_id", "chunk_id").distinct()


def query_set(question_raw: DataFrame, answer_raw: DataFrame, most: int | None = None, from_questions: int = 60) -> DataFrame:
    """(query_id, query_type, query, expected): queries that should find a stored answer.

    Of each question with a stored answer and a title over 10 characters: the
    title, its first six words (if over 10 characters) and the first sentence of
    the body, or its first 100 characters if it has no full stop (if over 20).
    Of each answer whose summary has over 20 characters: the first two items of
    the summary's list, its first 150 characters if the list can't be read, the
    summary itself if it is none (if over 15).  A question's answers are those it
    lists, separated by commas, else the one of its own number.

    All of them by default.  With ``most``, questions are taken in the files'
    order up to the one that reaches ``from_questions`` queries, and all is cut
    to ``most``.
    """
    stored = answer_raw.select(F.concat(F.lit("a_"), _named(answer_raw, "Answer Id", "answer_id")).alias("doc")).distinct()
    row = lambda raw: F.col("_row.at") if _order(raw) else F.lit(0).cast("long")
    q = question_raw.select(
        F.struct(row(question_raw).alias("row"), _named(question_raw, "Question Id", "question_id").alias("id")).alias("place"),
        _named(question_raw, "Question Id", "question_id").alias("id"),
        _named(question_raw, "Question Title", "question_title").alias("title"),
        _named(question_raw, "Question Body", "question_body").alias("body"),
        _named(question_raw, "Answer Posts", "answer_posts").alias("posts"),
    ).where("length(title) > 10")
    number = F.concat(F.lit("a_"), F.trim(F.col("post.p")))
    listed = q.select("place", "id", F.posexplode(F.split("posts", ",")).alias("at", "p")).select("place", "id", F.struct("at", "p").alias("post")).where("trim(post.p) <> ''")
    listed = listed.select("place", "id", F.col("post.at").alias("at"), number.alias("doc"))
    own = q.select("place", "id", F.lit(-1).alias("at"), F.concat(F.lit("a_"), F.col("id")).alias("doc"))
    found = listed.unionByName(own).join(stored, "doc", "left_semi").groupBy("place", "id").agg(F.array_sort(F.collect_list(F.struct("at", "doc"))).alias("found"))
    of_list = F.filter("found", lambda x: x["at"] >= 0)
    expected = F.transform(F.when(F.size(of_list) > 0, of_list).otherwise(F.col("found")), lambda x: x["doc"])
    kept = q.join(found, ["place", "id"]).withColumn("expected", expected)
    body = F.coalesce(F.array_join(list_literal(F.col("body")), " "), "body")
    sentence = F.when(body.contains("."), F.split_part(body, F.lit("."), F.lit(1))).otherwise(F.substring(body, 1, 100))
    kinds = [
        ("question_title_to_answer", "eval_q2a_", F.col("title"), 10),
        ("question_short_to_answer", "eval_q2a_short_", F.array_join(F.slice(F.filter(F.split("title", r"(?U)\s+"), lambda w: w != ""), 1, 6), " "), 10),
        ("question_body_to_answer", "eval_qbody2a_", F.when(F.length("body") > 20, sentence), 20),
    ]
    made = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("kind"), F.lit(p).alias("prefix"), t.alias("t"), F.lit(n).alias("over")) for i, (k, p, t, n) in enumerate(kinds)))
    asked = kept.select("place", "id", "expected", F.explode(made).alias("k")).where("length(k.t) > k.over")
    asked = asked.select("place", F.struct(F.lit(0).alias("part"), "place", "k.at").alias("order"), F.concat(F.col("k.prefix"), F.col("id")).alias("query_id"), F.col("k.kind").alias("query_type"), F.col("k.t").alias("query"), "expected")
    if most is not None:
        # questions before which fewer than ``from_questions`` queries stand
        sizes = asked.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").limit(from_questions)
        before = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        asked = asked.join(sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < from_questions).select("place"), "place", "left_semi")
    answer_id, summary = _named(answer_raw, "Answer Id", "answer_id"), _named(answer_raw, "Summary", "summary")
    s = answer_raw.select(F.struct(row(answer_raw).alias("row"), answer_id.alias("id")).alias("place"), summary.alias("summary")).where("length(summary) > 20")
    is_list = F.col("summary").startswith("[") & F.col("summary").endswith("]")
    short = F.when(~is_list, F.col("summary")).otherwise(F.coalesce(F.array_join(F.slice(list_literal(F.col("summary")), 1, 2), " "), F.substring("summary", 1, 150)))
    told = s.select(
        F.struct(F.lit(1).alias("part"), "place", F.lit(0).alias("at")).alias("order"),
        F.concat(F.lit("eval_a2a_"), F.col("place.id")).alias("query_id"),
        F.lit("answer_summary_to_answer").alias("query_type"),
        short.alias("query"),
        F.array(F.concat(F.lit("a_"), F.col("place.id"))).alias("expected"),
    ).where("length(query) > 15")
    everything = asked.drop("place").unionByName(told)
    if most is not None:
        everything = everything.orderBy("order").limit(most)
    return everything.drop("order")


def ground_truth(question_raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, query_text, n_answers, relevant): one query per question with listed answers and a title.

    ``relevant`` are the chunks (external_id, chunk_id) of the listed answers,
    which may be none.
    """
    posts = F.trim(_named(question_raw, "Answer Posts", "answer_posts"))
    ids = F.coalesce(list_literal(posts), F.when(posts.try_cast("long").isNotNull(), F.array(posts)))
    q = question_raw.select(
        _named(question_raw, "Question Id", "question_id").alias("query_id"),
        F.trim(F.concat_ws(" ", _named(question_raw, "Question Title", "question_title"), F.coalesce(_named(question_raw, "Question Body", "question_body"), F.lit("")))).alias("query_text"),
        _named(question_raw, "Question Title", "question_title").alias("title"),
        ids.alias("ids"),
    ).where("trim(title) <> '' AND size(ids) > 0")
    listed = q.select("query_id", F.explode(F.transform(F.array_distinct("ids"), lambda i: F.concat(F.lit("a_"), i))).alias("external_id"))
    found = listed.join(chunks.select("external_id", "chunk_id"), "external_id").groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("relevant"))
    return q.join(found, "query_id", "left").select("query_id", "query_text", F.size("ids").alias("n_answers"), F.coalesce("relevant", F.array().cast(chunks.select(F.array("chunk_id")).schema[0].dataType)).alias("relevant"))


def agent_questions(question_raw: DataFrame) -> DataFrame:
    """Questions for the agent: the body's first item is the title, the others the body.

    Rows whose body is no list or whose type is no number are left out, as rows
    that can't be read.
    """
    items = list_literal(_named(question_raw, "Question Body", "question_body"))
    tags, posts = F.trim(_named(question_raw, "Tags", "tags")), F.trim(_named(question_raw, "Answer Posts", "answer_posts"))
    strings = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(list_literal(c))
    title, body = F.coalesce(F.try_element_at("items", F.lit(1)), F.lit("")), F.array_join(F.slice("items", 2, 2**31 - 1), " ")
    rows = question_raw.select(
        _named(question_raw, "Question Id", "question_id").alias("question_id"),
        _named(question_raw, "Question Type", "question_type").try_cast("int").alias("question_type"),
        items.alias("items"),
        strings(tags).alias("tags"),
        strings(posts).alias("answer_posts"),
        *_order(question_raw),
    ).where("items IS NOT NULL AND question_type IS NOT NULL AND tags IS NOT NULL AND answer_posts IS NOT NULL")
    full = F.regexp_replace(F.concat(title, F.lit("\n\n"), body), r"^(?U)\s+|(?U)\s+$", "")
    return rows.select("question_id", "question_type", title.alias("question_title"), body.alias("question_body"), full.alias("question_full_text"), "tags", "answer_posts", *_order(question_raw))


def _stand_alone_list(c: Column) -> Column:
    """Items of a list literal without blanks, any other text as one item, none for an empty one."""
    items = F.filter(F.transform(list_literal(c), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(items, F.array(F.trim(c))))


def stand_alone(question_raw: DataFrame, answer_raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of questions and answers alike, each post a document of its own.

    Documents: id, content, content_hash, post_type, title, tags, question_type,
    has_summary, summary, char_count; without content there is none.  Queries:
    query_id, query, expected, query_type, of titles over 10 characters and of
    the first sentence of summaries over 20.
    """
    none = F.lit(None).cast("string")
    title, kind = F.coalesce(_named(question_raw, "Question Title", "question_title"), F.lit("")), _named(question_raw, "Question Type", "question_type")
    q = question_raw.select(
        _named(question_raw, "Question Id", "question_id").alias("n"),
        title.alias("title"),
        F.array_join(_stand_alone_list(_named(question_raw, "Question Body", "question_body")), " ").alias("body"),
        _stand_alone_list(_named(question_raw, "Tags", "tags")).alias("tags"),
        F.when(kind.rlike("^[0-9]+$"), kind.try_cast("int")).alias("question_type"),
    )
    both = F.concat(F.lit("Title: "), F.col("title"), F.lit("\n\nQuestion: "), F.col("body"))
    content = F.when((F.col("title") != "") & (F.col("body") != ""), both).otherwise(F.concat("title", "body"))
    q = q.select(F.concat(F.lit("q_"), F.col("n")).alias("id"), "n", content.alias("content"), F.lit("question").alias("post_type"), "title", "tags", "question_type", F.lit(False).alias("has_summary"), none.alias("summary"))
    a = answer_raw.select(
        _named(answer_raw, "Answer Id", "answer_id").alias("n"),
        F.array_join(_stand_alone_list(_named(answer_raw, "Answer Body", "answer_body")), " ").alias("body"),
        F.nullif(F.array_join(_stand_alone_list(_named(answer_raw, "Summary", "summary")), " "), F.lit("")).alias("summary"),
    )
    content = F.when(F.col("summary").isNotNull(), F.concat(F.lit("Answer: "), F.col("body"), F.lit("\n\nSummary: "), F.col("summary"))).otherwise(F.col("body"))
    a = a.select(F.concat(F.lit("a_"), F.col("n")).alias("id"), "n", content.alias("content"), F.lit("answer").alias("post_type"), none.alias("title"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("int").alias("question_type"), F.col("summary").isNotNull().alias("has_summary"), "summary")
    posts = q.unionByName(a).where("trim(content) <> ''")
    documents = posts.drop("n").withColumns({"content_hash": F.substring(F.sha2("content", 256), 1, 12), "char_count": F.length("content")})
    asked = F.when((F.col("post_type") == "question") & (F.length("title") > 10), F.col("title"))
    asked = asked.when((F.col("post_type") == "answer") & (F.length("summary") > 20), F.concat(F.trim(F.split_part("summary", F.lit("."), F.lit(1))), F.lit(".")))
    prefix = F.when(F.col("post_type") == "question", "eval_q_").otherwise("eval_a_")
    named = F.when(F.col("post_type") == "question", "question_title").otherwise("answer_summary")
    queries = posts.select(F.concat(prefix, F.col("n")).alias("query_id"), asked.alias("query"), F.array("id").alias("expected"), named.alias("query_type"))
    return documents, queries.where("length(query) > 10")


class QaAdapter:
    """The adapter of question and answer posts in a folder of two CSV files."""

    source_name = "stackoverflow_sosum"

    def __init__(self, folder: str, version: str = "1.0.0") -> None:
        self.folder, self.version = folder, version

    def _raw(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        q, a = post_files(spark, self.folder)
        return read_csv(spark, q), read_csv(spark, a)

    def read_rows(self, spark: SparkSession, split: str = "all") -> DataFrame:
        """Questions, then answers; the posts have no splits, so ``split`` is not used."""
        q, a = self._raw(spark)
        return rows(questions(q), answers(a))

    def to_documents(self, posts: DataFrame, split: str = "all") -> DataFrame:
        named = F.lit(split).alias("split")
        docs = answer_documents(posts.where("post_type = 'question'"), posts.where("post_type = 'answer'"))
        return docs.select("*", F.lit(self.source_name).alias("source"), F.lit(self.version).alias("dataset_version"), named)

    def evaluation_queries(self, posts: DataFrame) -> DataFrame:
        """All queries of the files; ``posts`` names the session."""
        return query_set(*self._raw(posts.sparkSession))


register_adapter("stackoverflow", QaAdapter)
register_adapter("sosum", QaAdapter)

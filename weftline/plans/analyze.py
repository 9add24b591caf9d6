"""Analysis of complaints: validate, locate, retrieve, classify, draft a reply; one plan over a batch of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import rules
from weftline.functions import text as X
from weftline.operators import crawl, location, retrieval
from weftline.operators.gram_index import build_index
from weftline.sources.workspace import small, store


@dataclass(frozen=True)
class Config:
    """Settings of an analysis; ``strict`` makes a suspicious pattern an error instead of a warning."""

    top_k: int = 3
    strict: bool = False
    backend: str = "tfidf"

    @classmethod
    def from_environment(cls, env: dict[str, str]) -> Config:
        return cls(int(env.get("TOP_K", "3")), env.get("SECURITY_LEVEL", "medium").lower() == "high", env.get("RAG_BACKEND", "tfidf").lower())


def active_backend(config: Config, embed: object | None) -> str:
    """The backend that retrieves: ``bge`` if it is asked for and there are embeddings, else ``tfidf``."""
    return "bge" if config.backend == "bge" and embed is not None else "tfidf"


def validated(c: Column, field: str, most: int, strict: bool = False) -> Column:
    """struct(is_valid, cleaned_value, errors, warnings) of a text: required, of at most ``most`` code points as given, escaped and
    tidied."""
    label = rules.FIELD_LABELS.get(field, field)
    empty = F.coalesce(X.strip(c), F.lit("")) == ""
    long = F.char_length(c) > most
    found, words = X.first_pattern(c), X.listed_words(c)
    keep = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    threat = F.concat(F.lit("检测到潜在安全威胁: "), found) if strict else F.lit(None).cast("string")
    errors = F.when(empty, F.array(F.lit(f"{label}不能为空"))).otherwise(keep(F.when(long, F.lit(f"{label}长度不能超过{most}个字符")), threat))
    listed = F.when(F.size(words) > 0, F.concat(F.lit("检测到敏感词汇: "), F.array_join(words, ", "))) if strict else F.concat(F.lit("检测到可疑内容: "), found)
    clean = F.when(empty, F.lit("")).otherwise(X.one_space(X.escape_html(c)))
    return F.struct((F.size(errors) == 0).alias("is_valid"), clean.alias("cleaned_value"), errors.alias("errors"), F.when(empty, none).otherwise(keep(listed)).alias("warnings"))


def validate(requests: DataFrame, strict: bool = False) -> DataFrame:
    """``requests`` (tag, title, body[, forced_unit]) with cleaned fields, ``errors`` and ``is_valid``; a field that fails is null.
    A row never raises: what is wrong with it is in its errors."""
    fields = [f for f in rules.FIELD_LIMITS if f in requests.columns]
    out = requests.withColumns({f"_{f}": validated(F.col(f), f, rules.FIELD_LIMITS[f], strict) for f in fields})
    given = lambda f: F.lit(True) if f != "forced_unit" else F.coalesce(F.col(f), F.lit("")) != ""
    none = F.array().cast("array<string>")
    errors = F.flatten(F.array(*[F.when(given(f), F.col(f"_{f}.errors")).otherwise(none) for f in fields]))
    out = out.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)
    return out.withColumns({f: F.when(given(f) & F.col(f"_{f}.is_valid"), F.col(f"_{f}.cleaned_value")) for f in fields}).drop(*[f"_{f}" for f in fields])


def admitted(requests: DataFrame, client: str, at: str, gap_seconds: float = rules.RATE_LIMIT_SECONDS, id_col: str = "request_id") -> DataFrame:
    """``requests`` with ``admitted``: whether a request came at least ``gap_seconds`` after its client's last admitted one (ties by id). One without a time is not
    admitted; requests without a client are those of one client. Ids have to be unique."""
    taken = store(crawl.rate_limited(requests, gap_seconds, client, at, id_col).select(F.col(id_col).alias("_taken")), "admitted")
    return requests.join(taken, F.col(id_col) == F.col("_taken"), "left").withColumn("admitted", F.col("_taken").isNotNull()).drop("_taken")


def analyze(
    requests: DataFrame, aliases: DataFrame, docs: DataFrame, scores: Callable[[DataFrame, DataFrame], DataFrame] | None = None, classify: Callable[[Column, Column, Column], Column] | None = None,
    generate: Callable[[Column], Column] | None = None, names: tuple[str, ...] = tuple(rules.DISTRICTS), config: Config = Config(), embed: Callable[[DataFrame], DataFrame] | None = None,
    limit_by: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per request (request_id, tag, title, body[, forced_unit]): is_valid, errors, location, units, retrieval, reply.

    ``scores(queries, docs)`` gives (query_id, doc_id, score). By default the backend of ``config`` does: ``bge`` takes products of the unit vectors that ``embed`` gives, (id, embedding) of
    (id, text); without ``embed``, and for any other name, it is TF-IDF (``active_backend``). A request without a hit is drafted from the simple prompt. ``classify(tag, title, body)`` an array of
    (unit, confidence), by default none; ``limit_by``, columns of client and time, refuses requests that come too soon (``admitted``) before anything else is done; ``generate(prompt)`` a reply, by default the template. A request that is not valid has errors
    and nothing else.
    """
    refused = None
    if limit_by:
        requests = store(admitted(requests, *limit_by), "requests")
        refused = requests.filter("NOT admitted").select("request_id", F.lit(False).alias("is_valid"), F.array(F.lit(rules.RATE_LIMIT_ERROR)).alias("errors"))
        requests = requests.filter("admitted").drop("admitted")
    checked = validate(requests, config.strict)
    fine = store(checked.filter("is_valid").withColumn("query", F.concat_ws(" ", "title", "body")), "requests")  # both are read by every step of a search
    placed = store(location.resolve(fine, aliases, "request_id", "query", names), "placed")
    queries = fine.select(F.col("request_id").alias("query_id"), "query").join(small(placed.select(F.col("id").alias("query_id"), F.col("district").alias("query_district"))), "query_id")
    if not scores and active_backend(config, embed) == "bge":
        scores = lambda q, d: retrieval.embedded_scores(q, d, embed, config.top_k)
    if scores:
        hits = retrieval.search(queries, docs, scores(queries, docs), config.top_k)
    else:
        hits = retrieval.tfidf_search(queries, docs, build_index(docs, X.document_text()), config.top_k)
    hit = F.struct("rank", "doc_id", "title", "doc_type", "district", "source", "score", "snippet", "matched_terms")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("retrieval"))  # at most top_k each
    units = classify(F.col("tag"), F.col("title"), F.col("body")) if classify else F.array().cast("array<struct<unit:string,confidence:double>>")
    rows = fine.join(small(placed.withColumnRenamed("id", "_id")), F.col("request_id") == F.col("_id"), "left").drop("_id").join(lists, F.col("request_id") == F.col("query_id"), "left").drop("query_id").withColumn("units", units)
    forced = F.nullif(F.col("forced_unit"), F.lit("")) if "forced_unit" in requests.columns else F.lit(None).cast("string")
    rows = rows.withColumn("primary_unit", F.coalesce(forced, F.get("units", F.lit(0))["unit"], F.lit(rules.DEFAULT_UNIT)))
    template = X.fallback_reply(F.col("district"), X.first_label(F.col("query")), F.col("primary_unit"), F.get("retrieval", F.lit(0))["title"])
    if generate:
        with_hits = X.context_prompt(F.col("primary_unit"), F.col("tag"), F.col("title"), F.col("body"), F.col("district"), F.coalesce("places", F.array().cast(rows.schema["places"].dataType)), F.col("retrieval"))
        without = X.simple_prompt(F.col("primary_unit"), F.col("district"), F.col("tag"), F.col("title"), F.col("body"))
        prompt = F.when(F.size("retrieval") > 0, X.render_chat(with_hits)).otherwise(X.render_chat(without))
        template = F.coalesce(F.nullif(X.tidy_generated(generate(prompt)), F.lit("")), template)
    done = rows.select("request_id", F.struct("district", "confidence", "method", "places", "address_snippets", "districts", "categories").alias("location"), "units", "primary_unit", "retrieval", template.alias("reply"))
    out = checked.select("request_id", "is_valid", "errors").join(done, "request_id", "left")
    return out if refused is None else out.unionByName(refused, allowMissingColumns=True)

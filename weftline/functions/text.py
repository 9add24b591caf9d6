"""String functions as Column expressions: whitespace, escaping, rules, terms, snippets, prompts and replies.

White space is Unicode's (ideographic and no-break spaces included), which a plain ``\\s`` or ``trim`` would leave.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import rules

SPACE = r"(?U)\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used: Catalyst would otherwise copy its expression into every
    branch that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def no_space(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "), "^ | $", "")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape_html(c: Column) -> Column:
    """What ``escape_html`` made, read back: its five references alone, each with its semicolon."""
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def within(c: Column, least: int, most: int) -> Column:
    """Whether the length in code points is within bounds."""
    return F.char_length(c).between(least, most)


def first_pattern(c: Column, patterns: Sequence[tuple[str, str]] = tuple(rules.SUSPICIOUS)) -> Column:
    """Name of the first pattern found (case ignored), else null."""
    return F.coalesce(*[F.when(c.rlike(f"(?iUd){p}"), F.lit(name)) for p, name in patterns])


def listed_words(c: Column, words: Sequence[str] = tuple(rules.SENSITIVE_WORDS)) -> Column:
    """All listed words that occur, case ignored, in list order."""
    return let(F.lower(c), lambda low: F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.lower(w))))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def labels_by_rule(c: Column, table: Sequence[tuple[str, str]] = tuple(rules.ISSUE_RULES)) -> Column:
    """Labels of all rules whose token occurs, in order, each once."""
    found = F.array(*[F.when(c.contains(token), F.lit(label)) for token, label in table])
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def first_label(c: Column, table: Sequence[tuple[str, str]] = tuple(rules.REPLY_ISSUE_RULES), default: str = rules.DEFAULT_ISSUE) -> Column:
    return F.coalesce(*[F.when(c.contains(token), F.lit(label)) for token, label in table], F.lit(default))


def first_group(c: Column, table: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first group with a word that occurs."""
    return F.coalesce(*[F.when(contains_any(c, words), F.lit(name)) for name, words in table], F.lit(default))


def _given(c: Column | None) -> Column:
    return F.array() if c is None else F.filter(F.array(c), lambda x: x.isNotNull() & (x != ""))


def query_terms(query: Column, district: Column | None = None, tag: Column | None = None, unit: Column | None = None, table: Sequence[tuple[str, str]] = tuple(rules.ISSUE_RULES), pattern: str = rules.QUERY_TERM) -> Column:
    """Issue labels, then what is given, then the query's own words; each once, first occurrence first."""
    parts = [labels_by_rule(query, table), _given(district), _given(tag), _given(unit), F.regexp_extract_all(query, F.lit(pattern), F.lit(0))]
    return F.array_distinct(F.concat(*[p.cast("array<string>") for p in parts]))


def joined_parts(*parts: Column, by: str = "\n", blanks: bool = False) -> Column:
    """The parts that are not empty, joined; with ``blanks`` all of them, null as an empty one."""
    if blanks:
        return F.concat_ws(by, *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat_ws(by, F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))


TEXT_PARTS = ("title", "content", "tags", "district", "doc_type", "issue_type", "unit", "applicable_tags")


def document_text(row: str = "", parts: Sequence[str] = TEXT_PARTS, blanks: bool = False) -> Column:
    """Searchable text of a corpus document: title, content, tags, district, type, issue, unit, applicable tags, or ``parts`` of these."""
    c = lambda n: F.col(f"{row}{n}")
    return joined_parts(*[F.concat_ws(" ", c(n)) if n.endswith("tags") else c(n) for n in parts], blanks=blanks)


def matched_terms(terms: Column, text: Column, most: int = 8) -> Column:
    """The first ``most`` terms that occur in the text; once they are found the text is searched no further."""
    none = F.array().cast("array<string>")
    return F.aggregate(terms, none, lambda kept, t: F.when((F.size(kept) < most) & (t != "") & text.contains(t), F.array_append(kept, t)).otherwise(kept))


def snippet(c: Column, most: int = 160) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def distinct_matches(c: Column, pattern: str) -> Column:
    """All matches in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


# --- replies and prompts ---------------------------------------------------------------------------------------------------


def clean_reply(c: Column) -> Column:
    """A training reply without letter heads, greetings and closing phrases.

    Heads anchor at the start and let a dot match line ends; tails also anchor at the end of each line ((?d): only \\n ends
    a line).
    """
    c = strip(c)
    for p in rules.REPLY_HEADS:
        c = F.regexp_replace(c, f"(?sU){p}", "")
    for p in rules.REPLY_TAILS:
        c = F.regexp_replace(c, f"(?smdU){p}", "")
    for p, to in rules.REPLY_TIDY:
        c = F.regexp_replace(c, p, to)
    return strip(c)


def is_low_quality(c: Column, patterns: Sequence[str] = tuple(rules.LOW_QUALITY), below: int = rules.LOW_QUALITY_LENGTH) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns)) & (F.char_length(c) < below)


def is_on_site_negative(c: Column, patterns: Sequence[str] = tuple(rules.ON_SITE_NEGATIVE)) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def classifier_text(tag: Column, title: Column, body: Column) -> Column:
    return F.concat(F.lit("【"), tag, F.lit("】"), title, F.lit("。"), body)


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def training_prompt(tag: Column, title: Column, body: Column) -> Column:
    return messages(rules.SYSTEM_TRAINING, F.concat(F.lit("标签: "), tag, F.lit("\n标题: "), title, F.lit("\n正文: "), body))


def simple_prompt(unit: Column, district: Column, tag: Column, title: Column, body: Column) -> Column:
    return messages(rules.SYSTEM_SIMPLE, F.concat(F.lit("回复单位: "), unit, F.lit("\n所属地区: "), F.coalesce(district, F.lit("未识别")), F.lit("\n标签: "), tag, F.lit("\n标题: "), title, F.lit("\n正文: "), body))


def context_prompt(unit: Column, tag: Column, title: Column, body: Column, district: Column, places: Column, hits: Column) -> Column:
    """The prompt with the first five places and the numbered retrieval hits."""
    place = F.array_join(F.transform(F.slice(places, 1, 5), lambda p: F.concat(F.lit("- "), p["matched_text"], F.lit(" -> "), p["district"], F.lit(" ("), p["source"], F.lit(")"))), "\n")
    line = lambda h, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), h["title"], F.lit(" | 类型:"), h["doc_type"], F.lit(" | 区域:"), F.coalesce(F.nullif(h["district"], F.lit("")), F.lit("全市")), F.lit(" | 摘要:"), h["snippet"])
    found = F.array_join(F.transform(hits, line), "\n")
    blank = lambda c, text: F.when(F.coalesce(c, F.lit("")) == "", F.lit(text)).otherwise(c)
    user = F.concat(
        F.lit("回复单位: "), unit, F.lit("\n留言标签: "), tag, F.lit("\n留言标题: "), title, F.lit("\n留言正文: "), body, F.lit("\n\n地名识别结果:\n- 行政区: "), blank(district, "未识别"),
        F.lit("\n- 识别明细:\n"), blank(place, "- 未提取到稳定地名"), F.lit("\n\n检索到的政策/案例上下文:\n"), blank(found, "无可用检索结果"),
    )
    return messages(rules.SYSTEM_WITH_CONTEXT, user)


def render_chat(prompt: Column, default_system: str = rules.CHAT_SYSTEM, generation: bool = True) -> Column:
    """Messages (role, content) in the chat markup. Consecutive tool results share one user turn."""
    own = F.element_at(prompt, 1)["role"] == "system"
    head = F.when(own, F.lit("")).otherwise(F.lit(f"<|im_start|>system\n{default_system}<|im_end|>\n"))

    def turn(m: Column, k: Column) -> Column:
        role = lambda at: F.get(prompt, at)["role"]
        tool = F.concat(
            F.when(F.coalesce(role(k - 1) == "tool", F.lit(False)), F.lit("")).otherwise(F.lit("<|im_start|>user")),
            F.lit("\n<tool_response>\n"), m["content"], F.lit("\n</tool_response>"),
            F.when(F.coalesce(role(k + 1) == "tool", F.lit(False)), F.lit("")).otherwise(F.lit("<|im_end|>\n")),
        )
        return F.when(m["role"] == "tool", tool).otherwise(F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))

    return F.concat(head, F.array_join(F.transform(prompt, turn), ""), F.lit("<|im_start|>assistant\n" if generation else ""))


def fallback_reply(district: Column, issue: Column, unit: Column, evidence: Column) -> Column:
    """The reply that stands in where no generator is plugged in."""
    or_ = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    return F.concat(
        F.lit("经核实，您反映的"), or_(district, "相关区域"), issue, F.lit("问题已转请"), unit, F.lit("结合现场情况进一步核查处理。我们将参考"), or_(evidence, "相关政策和类似案例"),
        F.lit("中的办理口径，重点核实问题成因、责任主体和整改安排，并督促相关单位及时反馈办理进展。"),
    )


def tidy_generated(c: Column, strict: bool = False) -> Column:
    """A generated reply without greeting and thanks; ``strict`` drops thanks only with a closing phrase."""
    c = F.regexp_replace(c, "^(您好|你好)[" + ("！!" if strict else "") + "，,：:\\s]+", "")
    return strip(F.regexp_replace(c, "(?s)感谢您.*?(支持|关注|理解).*?$" if strict else "(?s)感谢您.*$", ""))


def supervised_example(prompt_ids: Column, answer_ids: Column, end_id: int, most: int) -> Column:
    """struct(input_ids, labels): the answer is cut before the prompt; prompt positions are labelled -100."""
    end = F.array(F.lit(end_id)).cast("array<int>")
    n = F.size(prompt_ids)
    room = F.lit(most) - n - 1
    mask = F.array_repeat(F.lit(-100), n).cast("array<int>")
    whole = F.concat(answer_ids, end)
    cut = F.concat(F.slice(answer_ids, F.lit(1), F.greatest(room, F.lit(0))), end)
    fits = (n + F.size(whole)) <= most
    answer = F.when(fits, whole).otherwise(cut)
    first = lambda c: F.concat(F.slice(c, 1, most - 1), end)
    over = ~fits & (room <= 0)
    ids = F.when(over, first(F.concat(prompt_ids, whole))).otherwise(F.concat(prompt_ids, answer))
    labels = F.when(over, first(F.concat(mask, whole))).otherwise(F.concat(mask, answer))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def full_tag(primary: Column, secondary: Column) -> Column:
    return joined_parts(primary, secondary, by="-")


def score_percent(score: Column) -> Column:
    return F.concat(F.format_number(score * 100, 1), F.lit("%"))


def doc_type_class(doc_type: Column, table: Sequence[tuple[str, str]] = (("政策", "policy"), ("案例", "case"))) -> Column:
    return first_label(doc_type, table, "reference")


def log_fields(tag: Column, title: Column, body: Column, query: Column, hits: Column) -> Column:
    """What a request leaves in the log: lengths, flags and the first 100 characters of the query."""
    return F.struct(
        tag.alias("tag"), F.coalesce(F.char_length(title), F.lit(0)).alias("title_length"), F.coalesce(F.char_length(body), F.lit(0)).alias("body_length"),
        F.substring(query, 1, 100).alias("query"), F.coalesce(F.size(hits) > 0, F.lit(False)).alias("has_hits"),
    )

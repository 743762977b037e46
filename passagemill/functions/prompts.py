"""Prompt text, chat content and usage fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.functions.text import CONTEXT_MARK, LONG_CLIP_SUFFIX, QUESTION_MARK, clip, let, strip

# Health profile fields and their labels, in prompt order.
PROFILE_LABELS = {
    "age": "年龄",
    "height": "身高(cm)",
    "weight": "体重(kg)",
    "systolic": "收缩压(mmHg)",
    "diastolic": "舒张压(mmHg)",
    "fastingGlucose": "空腹血糖(mmol/L)",
    "postprandialGlucose": "餐后血糖(mmol/L)",
    "hba1c": "糖化血红蛋白(%)",
    "totalCholesterol": "总胆固醇(mmol/L)",
    "triglyceride": "甘油三酯(mmol/L)",
    "ldl": "LDL-C(mmol/L)",
    "hdl": "HDL-C(mmol/L)",
}
PROFILE_HEAD, REPORT_HEAD = "身体指标：\n", "检测报告解析文本：\n"
REFERENCE_HEAD = "参考答案（可参考但不要照抄）：\n"


def _section(head: str, body: Column) -> Column:
    """Null when the body is blank, so that concat_ws leaves the section out."""
    text = strip(F.coalesce(body.cast("string"), F.lit("")))
    return F.when(text != "", F.concat(F.lit(head), text))


def profile_text(profile_json: Column) -> Column:
    """One ``- label: value`` line per filled field of a JSON health profile."""
    fields = F.from_json(profile_json, ", ".join(f"{key} string" for key in PROFILE_LABELS))
    return let(
        fields, lambda f: F.concat_ws("\n", *[_section(f"- {label}: ", f[key]) for key, label in PROFILE_LABELS.items()])
    )


def user_text(question: Column, context: Column, profile_json: Column | None = None, report: Column | None = None) -> Column:
    sections = [
        F.concat(F.lit(QUESTION_MARK), strip(F.coalesce(question, F.lit("")))),
        _section(CONTEXT_MARK + "\n", context),
    ]
    if profile_json is not None:
        sections.append(_section(PROFILE_HEAD, profile_text(profile_json)))
    if report is not None:
        sections.append(_section(REPORT_HEAD, report))
    return F.concat_ws("\n\n", *sections)


def training_prompt(question: Column, context: Column, question_chars: int = 500, context_chars: int = 2400) -> Column:
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit(QUESTION_MARK), clip(question, question_chars, LONG_CLIP_SUFFIX)),
        _section(CONTEXT_MARK + "\n", clip(context, context_chars, LONG_CLIP_SUFFIX)),
    )


def input_block(
    question: Column,
    context: Column,
    reference: Column,
    question_chars: int = 500,
    context_chars: int = 2400,
    reference_chars: int = 1200,
) -> Column:
    return F.concat_ws(
        "\n\n",
        training_prompt(question, context, question_chars, context_chars),
        _section(REFERENCE_HEAD, clip(reference, reference_chars, LONG_CLIP_SUFFIX)),
    )


def message_text(content: Column) -> Column:
    """Text of a stored message: a bare string, the ``text`` of an object, else the JSON itself."""

    def read(value: Column) -> Column:
        variant = F.try_parse_json(value)
        inner_kind = F.schema_of_variant(F.try_variant_get(variant, "$.text", "variant"))
        return (
            F.when(F.schema_of_variant(variant) == "STRING", strip(F.try_variant_get(variant, "$", "string")))
            .when(inner_kind == "STRING", strip(F.get_json_object(value, "$.text")))
            .otherwise(value)
        )

    return let(strip(F.coalesce(content, F.lit(""))), read)


def usage_fields(prompt_tokens: Column, completion_tokens: Column) -> dict[str, Column]:
    asked, written = F.coalesce(prompt_tokens, F.lit(0)), F.coalesce(completion_tokens, F.lit(0))
    return {"prompt_tokens": asked, "completion_tokens": written, "total_tokens": asked + written}


RETRIEVED_DOCS = "array<struct<title:string,source:string,headings:string,content:string>>"


def retrieved_docs(docs: Column) -> Column:
    """Missing fields become empty strings; entries with nothing in them are dropped."""
    names = ("title", "source", "headings", "content")
    filled = F.transform(
        F.coalesce(docs, F.array().cast(RETRIEVED_DOCS)),
        lambda d: F.struct(*[F.coalesce(d[n], F.lit("")).alias(n) for n in names]),
    )
    return F.filter(filled, lambda d: F.concat(*[d[n] for n in names]) != "")


def first_nonempty_docs(*candidates: Column) -> Column:
    cleaned = [retrieved_docs(c) for c in candidates]
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in cleaned], F.array().cast(RETRIEVED_DOCS))


# Fixed value: key of a cited document without title and source.
UNKNOWN_CITATION = "未知来源"


def citation_key(doc: Column) -> Column:
    name = F.coalesce(F.nullif(doc["title"], F.lit("")), F.nullif(doc["source"], F.lit("")), F.lit(UNKNOWN_CITATION))
    return F.lower(strip(name))


def citations(docs: Column) -> Column:
    """Each cited title (or source) once, at its first place; one message cites few documents."""

    def firsts(ds: Column) -> Column:
        return let(
            F.transform(ds, citation_key),
            lambda keys: F.filter(ds, lambda d, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1),
        )

    return let(docs, firsts)

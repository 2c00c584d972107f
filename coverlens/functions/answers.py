"""Model answers: chat envelope to text, text to a typed record."""
from pyspark.sql import Column, functions as F, types as T

from coverlens.functions.text import as_col, bind, strip
from coverlens.schemas import ANSWER

_CHECKED = T.StructType(ANSWER.fields + [T.StructField("_broken", T.StringType())])
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}


def answer_text(envelope) -> Column:
    """The answer inside a chat-completion envelope."""
    return F.get_json_object(as_col(envelope), "$.choices[0].message.content")


def _one_value(c) -> Column:
    """True when the text is exactly one JSON value with nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1, F.lit(False))


def unfenced(c) -> Column:
    """The text without a Markdown code fence around it."""
    def body(t):
        return F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return bind(strip(c), lambda t: F.when(t.startswith("```"), body(t)).otherwise(t))


def _object_span(clean) -> Column:
    """The part of the text to read as an object, NULL when there is none."""
    head = F.instr(clean, "{")
    tail = F.length(clean) - F.instr(F.reverse(clean), "}") + 1
    return (F.when(clean.startswith("{") & clean.endswith("}"), clean)
            .when((head > 0) & clean.contains("}") & (tail > head) & ~_one_value(clean),
                  clean.substr(head, tail - head + 1)))


def empty_answer(c) -> Column:
    """True when the object in the text has no fields at all."""
    return bind(unfenced(c), lambda clean: F.coalesce(_object_span(clean).rlike(r"^\{\s*\}$"), F.lit(False)))


def parse_answer(c) -> Column:
    """Answer text to a record of strings, NULL when no JSON object can be read.

    The text as a whole comes first, then the span from its first to its last
    brace. A text that is valid JSON but no object gives NULL. Every step is
    bound, so that a text is parsed once and not once per field.
    """
    def checked(span):
        return bind(F.from_json(span, _CHECKED, _OPTIONS), lambda r: F.when(
            r["_broken"].isNull(), F.struct(*[r[f].alias(f) for f in ANSWER.fieldNames()])))
    return bind(unfenced(c), lambda clean: bind(_object_span(clean), lambda span: F.when(_one_value(span), checked(span))))

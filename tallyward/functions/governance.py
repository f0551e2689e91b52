"""Autonomy tiers, outcomes, trace steps, error classes and conditions, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the policy.
CONFIDENCE_FLOOR, AUTO_ALLOW_MAX = 0.75, 500.0
#: Substrings that mark an error as permanent (looked for first) or as passing.
PERMANENT = ("auth", "unauthorized", "forbidden", "permission", "invalid", "syntax", "does not exist", "not found", "constraint", "programmingerror")
TRANSIENT = ("timeout", "timed out", "connection", "connectionerror", "connectionreset", "temporarily", "unavailable", "rate limit", "ratelimit", "429", "503", "502", "504", "broken pipe", "reset by peer", "econnreset")


def autonomy_tier(decision: Column, confidence: Column, amount: Column) -> Column:
    """The tier of a decision; rules are tried in this order, and the first that holds decides."""
    return (
        F.when(decision == "ESCALATE", "SUGGEST")
        .when(confidence.isNull() | (confidence < CONFIDENCE_FLOOR), "SUGGEST")
        .when(decision == "BLOCK", "NOTIFY_ONLY")
        .when(amount <= AUTO_ALLOW_MAX, "AUTO_APPROVE")
        .otherwise("NOTIFY_ONLY")
    )


def outcome_correct(decision: Column, is_fraud: Column) -> Column:
    """Null for escalations."""
    return F.when(decision != "ESCALATE", (decision == "BLOCK") == F.coalesce(is_fraud, F.lit(False)))


def fraud_probability(decision: Column, confidence: Column) -> Column:
    """The probability of fraud that a decision implies; null for escalations and missing confidences."""
    return F.when(decision == "BLOCK", confidence).when(decision == "ALLOW", 1.0 - confidence)


def surfaced_patterns(elevated: Column, label: Column) -> Column:
    """Distinct upper-case patterns of a comma-joined string (null: none), and the final label unless it is NONE."""
    listed = F.filter(F.transform(F.split(F.coalesce(elevated, F.lit("")), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    own = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    return F.array_sort(F.array_distinct(F.when((own != "") & (own != "NONE"), F.array_append(listed, own)).otherwise(listed)))


def step_type(role: Column, has_tool_calls: Column, name: Column) -> Column:
    """Kind of a trace step by the message's role."""
    return (
        F.when(role.isin("user", "human"), "INPUT")
        .when(role == "tool", "TOOL_OUTPUT")
        .when(role.isin("assistant", "ai") & has_tool_calls, "TOOL_CALL")
        .when(role.isin("assistant", "ai") & (name == "orchestrator"), "HANDOFF")
        .when(role.isin("assistant", "ai"), "REASONING")
        .otherwise("OTHER")
    )


def error_class(message: Column) -> Column:
    """PERMANENT or TRANSIENT by markers in the message; unknown errors are permanent."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda marks: low.rlike("|".join(marks))
    return F.when(has(PERMANENT), "PERMANENT").when(has(TRANSIENT), "TRANSIENT").otherwise("PERMANENT")


#: The comparisons that a condition may make. A condition is a reference, one of these, and a literal.
COMPARISONS = (">=", "<=", "==", "!=", ">", "<")


def condition_parts(text: Column) -> Column:
    """struct(ref, op, literal) of a condition; null if malformed. Quotes around the literal are taken off.

    The first comparison in the text parts it. What is left of it must be a step's or the trigger's name, with a field if
    need be; what is right of it must be quoted, or be without white space.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    op = F.regexp_extract(text, "|".join(COMPARISONS), 0)
    at = F.instr(text, op)
    ref, literal = bare(F.substring(text, F.lit(1), at - 1)), bare(F.substring(text, at + F.length(op), F.length(text)))
    root, field = F.substring_index(ref, ".", 1), F.substring(ref, F.locate(".", ref) + 1, F.length(ref))
    named = root.rlike("^[$](trigger|step_[0-9]+)$") & ((root == ref) | field.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    first, inner = F.substring(literal, 1, 1), F.substring(literal, F.lit(2), F.length(literal) - 2)
    quoted = first.isin("'", '"') & (F.length(literal) >= 2) & F.endswith(literal, first) & ~F.contains(inner, first)
    whole = quoted | ((literal != "") & ~literal.rlike(r"\s"))
    unquoted = F.when(first.isin("'", '"') & (F.length(literal) >= 2) & F.endswith(literal, first), inner).otherwise(literal)
    return F.when((op != "") & named & whole, F.struct(ref.alias("ref"), op.alias("op"), unquoted.alias("literal")))


def compare(left: Column, op: Column, literal: Column) -> Column:
    """left OP literal, both given as strings: as numbers if the literal is one, else as text.

    Null if the literal is a number and the left side isn't: such a pair can't be compared.
    """
    number, other = literal.try_cast("double"), left.try_cast("double")

    def by(a: Column, b: Column) -> Column:
        return F.when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == "==", a == b).when(op == "!=", a != b).when(op == ">", a > b).when(op == "<", a < b)

    return F.when(number.isNotNull(), by(other, number)).otherwise(by(left, literal))

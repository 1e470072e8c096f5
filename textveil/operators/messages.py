"""Chat messages from every dataset layout, and their rendering to text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.sqltext import ident, let, lit, stripped


def _dialogue(user: str, assistant: str) -> str:
    return (
        f"array(named_struct('role', 'user', 'content', {user}), "
        f"named_struct('role', 'assistant', 'content', {assistant}))"
    )


def _text(column: str) -> str:
    return f"coalesce(cast({ident(column)} as string), '')"


def messages_sql(df: DataFrame, layout: str) -> str:
    """SQL for ``array<struct<role, content>>`` of one record."""
    if layout == "CHATML":
        return "transform(messages, m -> named_struct('role', m.role, 'content', m.content))"
    if layout == "SHARE_GPT":
        return (
            "transform(conversations, m -> named_struct('role', "
            "CASE WHEN lower(m.`from`) IN ('human', 'user') THEN 'user' "
            "WHEN lower(m.`from`) = 'system' THEN 'system' ELSE 'assistant' END, "
            "'content', coalesce(m.value, '')))"
        )
    if layout == "ALPACA":
        user = _text("instruction")
        if "input" in df.columns:
            extra = f"concat({lit(chr(10) * 2 + 'Input: ')}, {_text('input')})"
            has_input = f"{stripped(_text('input'))} != ''"
            user = f"concat({user}, CASE WHEN {has_input} THEN {extra} ELSE '' END)"
        return _dialogue(user, _text("output"))
    pairs = {
        "PROMPT_RESPONSE": ("prompt", "response"),
        "QA": ("question", "answer"),
        "QLA": ("question", "long_answer"),
    }
    if layout not in pairs:
        raise ValueError(f"No chat form for layout {layout!r}")
    user, assistant = pairs[layout]
    return _dialogue(_text(user), _text(assistant))


def to_messages(df: DataFrame, layout: str, name: str = "messages") -> DataFrame:
    return df.withColumn(name, F.expr(messages_sql(df, layout)))


def messages_from_turns(
    turns: DataFrame, conversation: str, turn: str, role: str, content: str
) -> DataFrame:
    """CHATML records from a long table of turns. A conversation is one record of
    the result, so its group is no larger than that."""
    listed = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")
            )
        )
    )
    return turns.groupBy(conversation).agg(
        F.transform(
            listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages")
    )


@dataclass(frozen=True)
class ChatTemplate:
    """Markers and role names of a rendered chat."""

    bos: str = "<bos>"
    turn_open: str = "<start_of_turn>"
    turn_close: str = "<end_of_turn>\n"
    assistant_name: str = "model"
    role_break: str = "\n"
    fold_system: bool = True
    system_break: str = "\n\n"
    trim: bool = True
    check_turns: bool = False


def render_sql(messages: str, template: ChatTemplate = ChatTemplate()) -> str:
    """SQL for the rendered chat, without a prompt for the next answer."""
    content = "coalesce(m.content, '')"
    if template.trim:
        content = stripped(content)
    role = f"CASE WHEN m.role = 'assistant' THEN {lit(template.assistant_name)} ELSE m.role END"
    turn = (
        f"concat({lit(template.turn_open)}, {role}, {lit(template.role_break)}, "
        f"CASE WHEN i = 0 THEN lead ELSE '' END, {content}, {lit(template.turn_close)})"
    )
    if template.check_turns:
        turn = (
            "CASE WHEN (m.role = 'user') != (i % 2 = 0) THEN "
            f"raise_error('Roles must alternate between user and assistant.') ELSE {turn} END"
        )
    body = f"concat({lit(template.bos)}, array_join(transform(turns, (m, i) -> {turn}), ''))"
    if not template.fold_system:
        return let("turns", messages, let("lead", "''", body))
    folded = "size(msgs) > 0 AND msgs[0].role = 'system'"
    return let(
        "msgs",
        messages,
        let(
            "turns",
            f"CASE WHEN {folded} THEN slice(msgs, 2, size(msgs)) ELSE msgs END",
            let(
                "lead",
                f"CASE WHEN {folded} THEN concat(coalesce(msgs[0].content, ''), "
                f"{lit(template.system_break)}) ELSE '' END",
                body,
            ),
        ),
    )


def render_chat(messages: str, template: ChatTemplate = ChatTemplate()) -> Column:
    return F.expr(render_sql(ident(messages), template))


def eos_sql(text: str, eos: str = "<eos>") -> str:
    return f"CASE WHEN endswith({text}, {lit(eos)}) THEN {text} ELSE concat({text}, {lit(eos)}) END"


def ensure_eos(text: str, eos: str = "<eos>") -> Column:
    return F.expr(eos_sql(ident(text), eos))

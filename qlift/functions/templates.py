"""Chat messages, chat rendering and prompt templates.

All texts here are our own.  A template is split on its ``#slot#`` markers on the driver
(templates are a handful of constants), and rendered as one ``concat`` of literal
segments and value columns: a value that itself contains ``#slot#``, ``$1`` or a
backslash is inserted verbatim and never re-substituted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import QUERY_MARK, _c, json_quote

SLOT_RE = re.compile(r"#([a-z_]+)#")

# Our own instruction and worked examples: a query and its rewrites for level 1 to 4.
INSTRUCTION = ("You receive one short question. Say it again as a complete request that leaves nothing for the answering "
               "model to guess, and print that request alone.")
ACKNOWLEDGEMENT = "Ready: one complete request per question, nothing else."
ANSWER_INSTRUCTION = "Answer the next question in a few plain sentences."
ANSWER_ACKNOWLEDGEMENT = "Fine, what is the question?"
EXAMPLES = [
    ("bread comes out flat", [
        "My sourdough hardly rises in the oven. Which causes are likely, and how do I test each of them?",
        "My sourdough hardly rises in the oven although it rested <Resting time>. Which causes are likely?",
        "My sourdough hardly rises in the oven although it rested <overnight in the fridge>. Which causes are likely?",
        "My sourdough hardly rises in the oven although it rested <two hours/overnight in the fridge/a full day>. Which causes are likely?",
    ]),
    ("java out of memory", [
        "A nightly Java job dies with a heap error. How do I find what fills the heap?",
        "On <Java version>, a nightly job with <Heap size> that reads <Input> dies with a heap error. What fills the heap?",
        "On <Java 21>, a nightly job with <4 GB of heap> that reads <one large CSV file> dies with a heap error. What fills the heap?",
        "On <Java 17/Java 21>, a nightly job with <2 GB of heap/4 GB of heap> that reads <one large CSV file/many small files> "
        "dies with a heap error. What fills the heap?",
    ]),
]

# Fixed value: the mark that ends a turn of the chat format the fine-tuned models were trained on.
TURN_CLOSE = "<|end|>\n"

# Profile -> (instruction, its role, acknowledgement or none, number of worked examples, example reply role, target role).
CHAT_PROFILES = {
    "llama": (INSTRUCTION, "system", None, 1, "system", "system"),
    "phi_mini": (INSTRUCTION, "user", ACKNOWLEDGEMENT, 2, "assistant", "assistant"),
    "phi_medium": (ANSWER_INSTRUCTION, "user", ANSWER_ACKNOWLEDGEMENT, 0, "assistant", "assistant"),
}


def _msg(role: str, content) -> Column:
    return F.struct(F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"))


def chat_messages(query, level, profile: str = "llama", target=None) -> Column:
    """Message array for a profile and level; ``target`` adds the training reply.  The answering profile
    (``phi_medium``) has no worked examples and no query mark: instruction, acknowledgement, the query itself."""
    instruction, role, ack, n_examples, reply_role, target_role = CHAT_PROFILES[profile]
    msgs = [_msg(role, instruction)]
    if ack:
        msgs.append(_msg("assistant", ack))
    for text, replies in EXAMPLES[:n_examples]:
        reply = F.element_at(F.array(*[F.lit(r) for r in replies]), _c(level).cast("int"))
        msgs += [_msg("user", f"{QUERY_MARK} {text}"), _msg(reply_role, reply)]
    msgs.append(_msg("user", F.concat(F.lit(QUERY_MARK + " "), _c(query)) if n_examples else _c(query)))
    if target is not None:
        msgs.append(_msg(target_role, _c(target)))
    return F.array(*msgs)


# Fixed value: what asks the model to go on.
GENERATION_PROMPT = "<|assistant|>\n"


def rendered_parts(messages, add_generation_prompt: bool = False) -> Column:
    """The rendered messages one by one (and the generation prompt last); their concatenation is the chat."""
    parts = F.transform(_c(messages), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(TURN_CLOSE)))
    return F.concat(parts, F.array(F.lit(GENERATION_PROMPT))) if add_generation_prompt else parts


def render_chat(messages, add_generation_prompt: bool = False) -> Column:
    """Fold messages into one string with role tags."""
    return F.array_join(rendered_parts(messages, add_generation_prompt), "")


def render(template: str, values: dict, json_mode: bool = True) -> Column:
    """Fill every ``#slot#`` of ``template`` from ``values`` (slot -> column)."""
    pieces: list[Column] = []
    pos = 0
    for m in SLOT_RE.finditer(template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        v = _c(values[m.group(1)])
        pieces.append(json_quote(v) if json_mode else v)
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces) if pieces else F.lit("")


def slots(template: str) -> list[str]:
    return list(dict.fromkeys(SLOT_RE.findall(template)))


# Our own judge request templates, one per metric (slots in #..#).
JUDGE_TEMPLATES = {
    "eqdq": ("Score how well the draft rewrites the question. Reply with one line per criterion.\n"
             "Question: #query#\nDraft: #draft#"),
    "aue": ("Estimate how much effort a user needs to understand the draft and to turn it into the final query. "
            "Reply in JSON.\nDraft: #draft#\nFinal: #final#"),
    "ha": ("Act as the user who asked the question: fill every <slot> of the draft with your choice and return "
           "JSON with final_enhanced_query.\nQuestion: #query#\nDraft: #draft#"),
    "lrqi": ("Score the answer to the question. Reply with one line per criterion.\n"
             "Question: #query#\nAnswer: #response#"),
    "rel": "Are these two questions about the same need? Reply in JSON.\nFirst: #previous#\nSecond: #current#",
    "sub": ("Would the draft made from the first question already cover the follow-up question? Reply in JSON.\n"
            "First: #previous#\nDraft: #draft#\nFollow-up: #current#"),
}

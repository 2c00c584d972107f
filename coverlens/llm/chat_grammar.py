r"""Conversations as training text, proven by reading it back.

The grammar: a conversation is a row of turns, each on lines of its own.

    turn      = "[INST] " text " [/INST]\n"                        role user
              | "<s>" text "</s>\n"                                role assistant
              | "<<SYS>>" text "<</SYS>>\n"                        role system
              | "<|role|>" role "<|text|>" text "<|end|>\n"        any other role
    text      = anything without a mark of the grammar

A turn is written as it is, parsed, and compared with its source. If that fails (the text holds a mark, or an escaped one),
every mark in it gets one more backslash behind its first character, and the turn is parsed and compared again; reading
takes one backslash away. Nothing else in a text can change, so the second reading is always identical; the operator raises
if it is not. The loss mask covers the assistants' texts.

Every turn is rendered and proven where it lies, in parallel. Reading a conversation back takes its turns in order through
one task, as one digest runs over them all, but a turn at a time, so memory does not grow with the conversation.

Edge cases: a null text or role is empty; a null turn comes first; rows with the same turn are ordered by their rendered
text, repeated rows stay; a null conv_id is a conversation; an empty table gives only what the caller adds; other columns
are ignored.
"""
import re

from pyspark.sql import functions as F

MARKS = re.compile(r"<(\\*)(/?s>|<SYS>>|</SYS>>|\|(?:role|text|end)\|>)|\[(\\*)(/?INST\])")
FORMS = {"user": ("[INST] ", " [/INST]\n"), "assistant": ("<s>", "</s>\n"), "system": ("<<SYS>>", "<</SYS>>\n")}
OPEN, MIDDLE, CLOSE = "<|role|>", "<|text|>", "<|end|>\n"
LEARNED = "assistant"

TURNS = "conv_id long, turn long, rendered string, mask_start int, mask_length int"


def escape(text):
    return MARKS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text):
    return MARKS.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role, text):
    """(rendered turn, start of its text)."""
    before, after = FORMS.get(role, (OPEN + role + MIDDLE, CLOSE))
    return before + text + after, len(before)


def _content(rendered, at):
    """Where the text that starts at `at` ends: at the first mark without a backslash."""
    for m in MARKS.finditer(rendered, at):
        if not (m[1] or m[3]):
            return m.start()
    raise ValueError(f"a text at {at} has no end")


def parse(rendered):
    """[(role, text, start of the text, its rendered length)]; raises ValueError for anything outside the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        role = next((r for r, (before, _) in FORMS.items() if rendered.startswith(before, at)), None)
        if role is None:
            if not rendered.startswith(OPEN, at):
                raise ValueError(f"no turn at {at}")
            end = _content(rendered, at + len(OPEN))
            if not rendered.startswith(MIDDLE, end):
                raise ValueError(f"no text at {end}")
            role, start, after = unescape(rendered[at + len(OPEN):end]), end + len(MIDDLE), CLOSE
        else:
            start, after = at + len(FORMS[role][0]), FORMS[role][1]
        end = _content(rendered, start)
        if after[0] == " ":  # the space before the mark belongs to it
            end -= 1
        if end < start or not rendered.startswith(after, end):
            raise ValueError(f"wrong end at {end}")
        turns.append((role, unescape(rendered[start:end]), start, end - start))
        at = end + len(after)
    return turns


def _reads_back(rendered, role, text):
    try:
        return [t[:2] for t in parse(rendered)] == [(role, text)]
    except ValueError:
        return False


def proven(role, text):
    """(rendered, start, length of the rendered text): the turn as it is if it reads back, else escaped."""
    for attempt in (lambda x: x, escape):
        shown = attempt(text)
        rendered, start = render(role if role in FORMS else attempt(role), shown)
        if _reads_back(rendered, role, text):
            return rendered, start, len(shown)
    raise ValueError(f"turn of role {role!r} does not read back")


def formatted(conversations):
    """One row per turn: its rendered text and the loss mask in it (length 0: none). A conversation is their row by turn."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                rendered, start, length = proven(role or "", text or "")
                out.append((rendered, start, length if role == LEARNED else 0))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()),
                                   pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                                  ["conv_id", "turn", "rendered", "mask_start", "mask_length"])

    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").mapInArrow(run, TURNS)


def read_back(turns):
    """One row per conversation, from the rendered text alone: turns, digests of turns and of the text under the mask."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def close(s):
            return s["id"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]

        now, done = None, []
        for batch in batches:
            for conv_id, rendered, start, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now is None or now["id"] != conv_id:
                    if now is not None:
                        done.append(close(now))
                    now = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                (role, text, _, _), = parse(rendered)
                learned = unescape(rendered[start:start + length])
                now["n"] += 1
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now["loss"].update(learned.encode("utf-8", "surrogatepass"))
                now["loss_chars"] += len(learned)
                now["chars"] += len(rendered)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done = []
        if now is not None:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*[close(now)]), kinds)], names)

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))

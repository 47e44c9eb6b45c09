"""Sections of prompts, chat templates and one-line views of actions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowmill.functions import actions as A

#: fixed values: the lines that begin a section, in both families of prompts
MARKS = {
    "current_state": (r"##\s*Current State\s*", r"Current UI State:\s*"),
    "next_state": (r"##\s*Next State\s*", r"Next UI State:\s*"),
    "action": (r"##\s*Action\s*", r"Action:\s*"),
    "instruction": (r"Task Instruction:\s*",),
    "history": (r"Action History:\s*",),
}
#: fixed values: what stands around the turns of a chat, by template
TEMPLATES = {
    "qwen": ("<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "llama3": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
    "default": ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"),
}
#: unix lines, so that ^ and $ mean \n alone
LINES = "(?dm)"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def user_part(prompt: Column) -> Column:
    """What follows the first line 'user', up to the last line 'assistant' after it; the whole text without such lines."""
    after = F.coalesce(A.found(prompt, r"(?dms)^user\s*$(.*)\z"), prompt)
    return F.coalesce(A.found(after, r"(?dms)\A(.*)^assistant\s*$"), after)


def section(body: Column, name: str, marks: dict[str, tuple[str, ...]] = MARKS) -> Column:
    """The first section of that name that isn't blank, trimmed and without lines like '[Screenshot]'; null if there is none."""
    own, every = "|".join(marks[name]), "|".join(m for x in marks.values() for m in x)
    parts = F.regexp_extract_all(body, F.lit(rf"(?dms)^(?:{own})$(.*?)(?=^(?:{every})$|\z)"), 1)
    clean = F.transform(parts, lambda x: stripped(F.regexp_replace(x, r"(?dm)^\[[^\]\n]*Screenshot\]\s*$", "")))
    return F.get(F.filter(clean, lambda x: x != ""), 0)


def sections(prompt: Column, marks: dict[str, tuple[str, ...]] = MARKS) -> Column:
    """A map of the sections that a prompt's user part has."""
    body = user_part(prompt)
    found = F.array(*(F.struct(F.lit(n).alias("key"), section(body, n, marks).alias("value")) for n in marks))
    return F.map_from_entries(F.filter(found, lambda x: x["value"].isNotNull()))


#: fixed values: lines that part the older prompts
OLDER = ("system\n", "\nuser\n\n## Current State\n", "\n\n## Action\n", "\nassistant")


def older_parts(prompt: Column) -> Column:
    """struct(system, state, action) of a prompt in the older form; the whole text as system and empty parts for any other."""
    start, state, action, end = (rf"\Q{mark}\E" for mark in OLDER)
    whole = rf"(?s)\A{start}(.*?){state}(.*?){action}(.*?){end}\n{{0,2}}\z"
    fits = prompt.rlike(whole)
    part = lambda k: F.when(fits, F.regexp_extract(prompt, whole, k))
    empty = F.when(prompt.isNotNull(), "")
    return F.struct(F.coalesce(part(1), prompt).alias("system"), F.coalesce(part(2), empty).alias("state"), F.coalesce(part(3), empty).alias("action"))


def _blocks(text: Column, mark: str, stop: str) -> Column:
    """All lines after a line that holds ``mark`` up to the next such line or one that fits ``stop``, trimmed as one text."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?dms)^[^\n]*\Q{mark}\E[^\n]*$(?:\n|\z)(.*?)(?=^[^\n]*\Q{mark}\E|{stop}|\z)"), 1)
    return stripped(F.array_join(parts, ""))


def current_state(text: Column) -> Column:
    """The block below '## Current State', up to the next heading; without one, that below 'Current UI State:', up to '[Screenshot]'."""
    first = _blocks(text, "## Current State", "^## ")
    return F.coalesce(F.nullif(first, F.lit("")), _blocks(text, "Current UI State:", r"^[^\n]*\[Screenshot\]|^## "))


def template_of(model: Column) -> Column:
    name = F.lower(model)
    return F.when(name.contains("qwen"), "qwen").when(name.contains("llama-3") | name.contains("llama3"), "llama3").otherwise("default")


def prefix(template: Column, system: Column, user: Column) -> Column:
    """All that comes before an answer."""
    texts = {n: F.concat(F.lit(a), system, F.lit(b), user, F.lit(c)) for n, (a, b, c) in TEMPLATES.items()}
    return F.when(template == "qwen", texts["qwen"]).when(template == "llama3", texts["llama3"]).otherwise(texts["default"])


def occurrences(text: Column, key: str) -> Column:
    return F.size(F.split(text, rf"\Q{key}\E", -1)) - 1


def replaced_once(text: Column, changes: dict[str, str]) -> Column:
    """Each key replaced by its value, one after the other; null unless each occurs exactly once when its turn comes."""
    for key, value in changes.items():
        text = F.when(occurrences(text, key) == 1, F.replace(text, F.lit(key), F.lit(value)))
    return text


def without_images(messages: Column, images: Column, changes: dict[str, dict[str, str]], mark: str = "<image>", shown: str = "[Screenshot]") -> Column:
    """Messages (role, text) with their images' marks replaced by role; null where marks and images differ in number or any mark stays."""
    marks = F.aggregate(messages, F.lit(0), lambda n, m: n + occurrences(m["text"], mark))

    def swapped(m):
        text = m["text"]
        for role, pairs in changes.items():
            text = F.when(m["role"] == role, replaced_once(m["text"], pairs)).otherwise(text)
        return F.struct(m["role"].alias("role"), text.alias("text"))

    done = F.transform(messages, swapped)
    good = F.forall(done, lambda m: F.coalesce(~m["text"].contains(mark) & ~m["text"].contains(shown), F.lit(False)))
    return F.when((marks == F.size(images)) & good, done)


def bare_page(key: Column) -> Column:
    """'page_7' as '7'; anything else stays."""
    return F.regexp_replace(key, r"\Apage_([0-9]+)\z", "$1")


def bare_number(name: Column) -> Column:
    """A number without leading zeros, null for a name that isn't one."""
    return F.when(name.rlike(r"\A[0-9]+\z"), F.regexp_replace(name, r"\A0+(?=[0-9])", ""))


def one_line(action: Column) -> Column:
    """An action as 'type  params  index=.. default=..'; text that isn't JSON is cut to 80 characters on one line (it is a display)."""
    a = F.try_parse_json(action)
    shown = lambda k: F.when(A.value(a, f"$.{k}", "string").isNotNull(), F.concat(F.lit(f"{k}="), A.value(a, f"$.{k}", "string")))
    params = F.coalesce(F.nullif(F.to_json(A.value(a, "$.params", "variant")), F.lit("{}")), F.lit(""))
    text = F.concat_ws("  ", F.coalesce(A.value(a, "$.type", "string"), F.lit("?")), params, F.concat_ws(" ", shown("index"), shown("default")))
    return F.when(a.isNull(), F.regexp_replace(F.substring(action, 1, 80), "\n", " ")).otherwise(stripped(text))

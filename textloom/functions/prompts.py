"""Prompt templates and prompt rendering expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: prompt texts of the original pipeline --------------------
ZERO_SHOT_HEAD = (
    "You are an anonymous user on a social media platform. You are NOT an AI Assistant.\n"
    "Write exactly ONE realistic, first-person social media post that expresses a \"")
ZERO_SHOT_TAIL = (
    "\" level of mental health severity.\n"
    "\n"
    "Guidelines:\n"
    "- Use natural, conversational language typical of Twitter or Reddit.\n"
    "- Keep the post between 1 and 4 sentences.\n"
    "\n"
    "Restrictions:\n"
    "- Do NOT include any names, locations, or contact details.\n"
    "- Do NOT repeat, paraphrase, or reference these instructions in your output.\n"
    "- Do NOT add any preamble, commentary, or explanation.\n"
    "- Do NOT use hashtags or emojis.\n"
    "\n"
    "Output ONLY the post text wrapped in <post></post> tags. Nothing else.")
FEW_SHOT_HEAD = ZERO_SHOT_HEAD
FEW_SHOT_MID = (
    "\" level of mental health severity.\n"
    "\n"
    "Here are some examples of the style and tone to aim for. Do NOT copy these directly:\n"
    "<examples>\n")
FEW_SHOT_TAIL = (
    "\n</examples>\n"
    "\n"
    "Guidelines:\n"
    "- Use natural, conversational language typical of Twitter or Reddit.\n"
    "- Keep the post between 1 and 4 sentences.\n"
    "\n"
    "Restrictions:\n"
    "- Do NOT include any names, locations, or contact details.\n"
    "- Do NOT repeat, paraphrase, or reference these instructions in your output.\n"
    "- Do NOT add any preamble, commentary, or explanation.\n"
    "- Do NOT use hashtags or emojis.\n"
    "\n"
    "Output ONLY the post text wrapped in <post></post> tags. Nothing else.")
EXAMPLE_SEP = "\n\n"
# generator model ids and their chat wrappers (matched case-sensitively on the id)
GENERATOR_MODELS = (("falcon", "tiiuae/Falcon3-7B-Instruct"),
                    ("mentallama", "klyang/MentaLLaMA-chat-7B"))
MENTALLAMA_MARK = "MentaLLaMA"
FALCON_MARK = "falcon"
# -----------------------------------------------------------------------------


def zero_shot(label: Column) -> Column:
    return F.concat(F.lit(ZERO_SHOT_HEAD), label, F.lit(ZERO_SHOT_TAIL))


def example_line(example_no: Column, text: Column) -> Column:
    """``Example i:\\n<text>`` for one example (1-based ``example_no``)."""
    return F.concat(F.lit("Example "), example_no.cast("string"), F.lit(":\n"), text)


def few_shot(label: Column, examples_block: Column) -> Column:
    return F.concat(F.lit(FEW_SHOT_HEAD), label, F.lit(FEW_SHOT_MID), examples_block,
                    F.lit(FEW_SHOT_TAIL))


def wrap_for_model(prompt: Column, model_id: Column) -> Column:
    """Chat wrapper by model id; 'falcon' is case-sensitive, so Falcon3 stays unwrapped (K3)."""
    return (F.when(F.instr(model_id, MENTALLAMA_MARK) > 0,
                   F.concat(F.lit("<s>[INST] "), prompt, F.lit(" [/INST]")))
             .when(F.instr(model_id, FALCON_MARK) > 0,
                   F.concat(F.lit("User: "), prompt, F.lit("\nAssistant:")))
             .otherwise(prompt))

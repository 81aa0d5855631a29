"""Prompts for a model: a task name, instructions, a line of three hyphens, then what to read. All are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "\n---\n"


def _prompt(task: str, instructions: str, *body: Column) -> Column:
    return F.concat(F.lit(f"{task}\n{instructions}{RULE}"), *(F.coalesce(b, F.lit("")) for b in body))


def split(prompt: str) -> tuple[str, str]:
    """Task and body of a prompt."""
    head, _, body = prompt.partition(RULE)
    return head.partition("\n")[0], body


def classify(text: Column) -> Column:
    return _prompt("CLASSIFY", "Does this passage belong to the story itself, or to licence, contents, notes or advertising?\nReply with the one word CONTENT or NONCONTENT.", text)


def characters(text: Column) -> Column:
    return _prompt("CHARACTERS", 'Name everybody who speaks here. Reply with JSON: {"characters": {"an_id": {"name": "...", "details": "looks, age, manner"}}}.\nIds are lower case with underscores.', text)


def same_people(cast: Column) -> Column:
    """cast: lines `id: name`."""
    return _prompt("DEDUP", 'Which of these ids name the same person (other spellings, titles, parts of a name, disguises)? Relatives are different people.\nReply with JSON: {"groups": [["id", "other_id"]]}; leave out ids that stand alone.', cast)


def narrator(title: Column, author: Column, sample: Column) -> Column:
    return _prompt("NARRATOR", 'Describe who should read this book aloud, as fits its mood. Reply with JSON: {"name": "Narrator", "bio": "voice, tone, pace"}.', title, F.lit("\n"), author, F.lit("\n"), sample)


def describe(char_id: Column, bio: Column) -> Column:
    """A voice description of one character."""
    role = F.when(char_id == "narrator", "Reads the whole book: clear, steady, able to suggest other voices.").otherwise("Speaks the lines of one character.")
    return _prompt("DESCRIBE", "Describe this voice in 60 to 100 words: sex, age, accent, pitch, timbre, pace, mood, habits. Reply with the description alone.", role, F.lit("\n"), char_id, F.lit(": "), bio)


def acoustic(char_id: Column, description: Column) -> Column:
    return _prompt("ACOUSTIC", "Put this voice into acoustic terms, in one sentence, unlike the voices given before.", char_id, F.lit(": "), description)


def voices(catalog: Column, cast: Column) -> Column:
    """catalog: its text; cast: lines `id: description`."""
    return _prompt(
        "VOICES", 'Give each character a voice of the list, or a blend as id*weight+id*weight, and a speed from 0.85 to 1.15; match sex and accent, and let no two sound alike.\nReply with JSON: {"character": {"voice": "...", "speed": 1.0}}.',
        catalog, F.lit(RULE), cast,
    )


def script(chunk: Column, speakers: Column) -> Column:
    """speakers: ids joined by commas."""
    return _prompt(
        "SCRIPT", 'Turn the passage into lines. What stands in quotation marks is spoken by a character, everything else by the narrator, word for word.\nReply with one JSON object a line: {"speaker_id": "...", "text": "..."}. Speakers:',
        speakers, F.lit(RULE), chunk,
    )

"""Training inputs: answer supervision, token accounting, image slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100
MAX_LENGTH = 8192


def answer_supervision(
    tokens: Column, start: Column, eos: int, image: int, pad_to: Column | None = None, pad: int | None = None, vocabulary: int = 2**31 - 1
) -> Column:
    """ids, labels, mask; null where the answer isn't a span that ends in its one end token.

    Labels are unshifted and IGNORE on prompt and padding. Ids are 0 up to the
    vocabulary's size; the image id is neither end nor padding.
    """
    pad = eos if pad is None else pad
    if not 2 <= vocabulary <= 2**31 - 1 or image in (eos, pad) or not all(0 <= i < vocabulary for i in (eos, image, pad)):
        raise ValueError("invalid vocabulary or token ids")
    n = F.size(tokens)
    width = pad_to if pad_to is not None else n
    answer = F.slice(tokens, start + 1, n - start)
    fine = (
        (n >= 3) & (n <= MAX_LENGTH) & (start >= 1) & (start <= n - 2) & (width >= n) & (width <= MAX_LENGTH)
        & (F.element_at(tokens, -1) == eos)
        & (F.size(F.filter(answer, lambda t: t == eos)) == 1)
        & ~F.array_contains(answer, image)
        & F.forall(tokens, lambda t: (t >= 0) & (t < vocabulary))
    )
    fill = lambda value: F.array_repeat(F.lit(value).cast("int"), width - n)
    real = tokens.cast("array<int>")
    return F.when(
        fine,
        F.struct(
            F.concat(real, fill(pad)).alias("ids"),
            F.concat(F.transform(real, lambda t, i: F.when(i >= start, t).otherwise(IGNORE)), fill(IGNORE)).alias("labels"),
            F.concat(F.transform(real, lambda t: F.lit(1)), fill(0)).alias("mask"),
        ),
    )


def accounting(supervised: Column, start: Column, image: int, limit: int = MAX_LENGTH) -> Column:
    """Sequence, prompt, supervised, image and remaining tokens of one example."""
    n = F.size(supervised["ids"])
    return F.struct(
        n.alias("sequence_tokens"),
        start.cast("int").alias("prompt_tokens"),
        F.size(F.filter(supervised["labels"], lambda x: x != IGNORE)).alias("supervised_tokens"),
        F.size(F.filter(supervised["ids"], lambda x: x == image)).alias("image_tokens"),
        (F.lit(limit) - n).alias("context_remaining"),
    )


#: Markers that a task may not hold, fixed.
RESERVED = ("<image>", "<fake_token_around_image>", "<global-img>", "<row_", "<|im_start|>", "<|im_end|>", "<end_of_utterance>", "\0")


def task_valid(task: Column) -> Column:
    """A task text: at most 32768 characters, no NUL, no reserved marker."""
    fine = F.length(task) <= 32768
    for marker in RESERVED:
        fine = fine & ~F.contains(task, F.lit(marker))
    return F.coalesce(fine, F.lit(False))


def prompt(images: Column, task: Column) -> Column:
    """The single-user chat text around image markers and a task; null for a bad task."""
    text = F.concat(F.lit("<|im_start|>User:"), images, task, F.lit("<end_of_utterance>\nAssistant:"))
    return F.when(task_valid(task), text)


def training_example(full: Column, prompt_ids: Column, eos: int, image: int) -> Column:
    """Supervision of a whole transcript; null unless it begins with exactly the prompt's ids."""
    n = F.size(prompt_ids)
    begins = F.slice(full, 1, F.greatest(n, F.lit(0))) == prompt_ids
    return F.when(begins, answer_supervision(full, n, eos, image))


def policy_problems(found: Column, wanted: dict[str, str]) -> Column:
    """Keys whose value differs from a closed policy, or that one side lacks: map of JSON texts against a fixed one."""
    policy = F.create_map(*[F.lit(x) for pair in sorted(wanted.items()) for x in pair])
    keys = F.array_union(F.map_keys(policy), F.map_keys(found))
    differs = lambda k: ~F.element_at(policy, k).eqNullSafe(F.element_at(found, k))
    return F.array_sort(F.filter(keys, differs))


def merge_slots(ids: Column, image: int, features: Column) -> Column:
    """ids as feature numbers: the n-th image slot takes the n-th feature; null if their counts differ."""
    slots = F.filter(F.transform(ids, lambda t, i: F.when(t == image, i)), lambda i: i.isNotNull())
    return F.when(
        F.size(slots) == F.size(features),
        F.transform(ids, lambda t, i: F.when(t == image, F.get(features, F.array_position(slots, i).cast("int") - 1))),
    )


def export_rows(examples: DataFrame, key: list[str], supervised: str) -> DataFrame:
    """key, position, id, label, mask: one row per token of every supervised example."""
    x = F.col(supervised)
    zipped = F.posexplode(F.arrays_zip(x["ids"].alias("id"), x["labels"].alias("label"), x["mask"].alias("mask"))).alias("position", "token")
    return examples.where(x.isNotNull()).select(*key, zipped).select(*key, "position", "token.id", "token.label", "token.mask")

"""Pipeline settings.

The constants below are fixed values of the original text-dataset pipeline;
results only match it when they are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (must equal the original pipeline) ----------------------
SPLIT_SEED = 67            # stratified split seed
TEST_SIZE = 0.2            # first split: held-out share
VAL_SIZE = 0.5             # second split: share of the held-out part that becomes test
MAX_TOKENS = 256           # token truncation length
EVAL_BATCH = 256           # evaluation batch (steps = ceil(rows / 256))
N_PER_LABEL = 10_000       # prompts per label
FEW_SHOT_K = 8             # examples per few-shot prompt
TEMPERATURES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)   # sweep grid found in the result folders
JUDGE_SAMPLE = 500         # audited rows per dataset
JUDGE_BATCH = 50           # texts per judge prompt
JUDGE_SEED = 42            # audit sampling seed
JUDGE_RETRIES = 3          # attempts per judge prompt
TRUNCATE_CHARS = 500       # text cut for judge prompts and flagged rows
PREVIEW_CHARS = 100        # preview length in flagged examples
TOP_FLAGGED = 3            # examples shown per dataset
GENERATORS = ("falcon", "mentallama")
MODES = ("FS", "ZS")
LABELS = ("mild", "minimum", "moderate", "severe")   # alphabetical: the position is the label id
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    split_seed: int = SPLIT_SEED
    test_size: float = TEST_SIZE
    val_size: float = VAL_SIZE
    max_tokens: int = MAX_TOKENS
    eval_batch: int = EVAL_BATCH
    # prompts per label, the same at every table size
    n_per_label: int = N_PER_LABEL
    few_shot_k: int = FEW_SHOT_K
    temperatures: tuple = TEMPERATURES
    judge_sample: int = JUDGE_SAMPLE
    judge_batch: int = JUDGE_BATCH
    judge_seed: int = JUDGE_SEED
    judge_retries: int = JUDGE_RETRIES
    truncate_chars: int = TRUNCATE_CHARS
    preview_chars: int = PREVIEW_CHARS
    top_flagged: int = TOP_FLAGGED
    # seed of the few-shot draw (the original draw was unseeded)
    prompt_seed: int = SPLIT_SEED
    # K1: the original deletes newlines, fusing words; True inserts a space instead
    newline_as_space: bool = False
    # hex digits of the hash used as rank bucket (16**3 = 4096 buckets per stratum)
    rank_bucket_digits: int = 3


DEFAULT = Config()
# classifiers trained here: multinomial naive Bayes on words and on word pairs
CLASSIFIERS = ("unigram_nb", "bigram_nb")
ALPHAS = (1.0, 0.1)        # smoothing candidates, numbered from 1; validation chooses
# the registered prompt queries make the original's number of prompts per label, the same at every table size
QUERY_CONFIG = DEFAULT

"""Column functions: strings, arrays, keyed randomness."""

from .arrays import (argmax_index, join_bools, join_ints, logsumexp, pad_right, shift_targets,
                     src_keep_tail, tgt_budget, truncate_head, window_slice)
from .keyed import keyed_uniform, keyed_uniform_sql
from .text import (extract_case_answer, extract_choices, extract_reply, extract_reply_last,
                   length_bucket, parse_judge_score, strip_markers, system_prefix, tokenize,
                   trim_all, whitespace_tokens, word_count)

__all__ = [
    "argmax_index", "join_bools", "join_ints", "logsumexp", "pad_right", "shift_targets",
    "src_keep_tail", "tgt_budget", "truncate_head", "window_slice",
    "keyed_uniform", "keyed_uniform_sql",
    "extract_case_answer", "extract_choices", "extract_reply", "extract_reply_last",
    "length_bucket", "parse_judge_score", "strip_markers", "system_prefix", "tokenize",
    "trim_all", "whitespace_tokens", "word_count",
]

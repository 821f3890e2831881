"""Fixed values and defaults.

Values marked fixed must equal the original project's for results to agree:
role markers, instruction texts, the answer patterns of the single-choice exam
and some numeric constants.  They are stated plainly, in their natural order.
The rest are public constants of the metrics or defaults of this library.
"""

# --- fixed values: role markers --------------------------------------------
PATIENT = "<|patient|>"
DOCTOR = "<|doctor|>"
SYSTEM = "<|system|>"

# --- fixed values: system prefix used by the prompt/target collator ----------
SYSTEM_PREFIX_TEXT = (
    "你是一个擅长心理咨询的人工智能助手，你将通过提问的方式一步一步引导用户回答，从而进行心理诊断。"
)

# --- fixed values: evaluation instructions -----------------------------------
CHOICE_INSTRUCTION = (
    "请你扮演中文心理咨询师，以下是中国关于心理咨询师等级考试的单项选择题，请选出其中的正确答案。\n"
)
DIALOGUE_INSTRUCTION = (
    "你是一个中文心理咨询智能化助手，下面是一些关于心理诊断的真实对话，请你扮演心理医生通过提问引导对患者进行诊断。"
)
CASE_INSTRUCTION = (
    "你是一个中文心理咨询智能化助手，以下是中国关于心理咨询师等级考试的案例分析题，请根据给出的材料回答问题。\n"
)
ANSWER_CUE = "\n答案："
CHOICES = ("A", "B", "C", "D")

# --- fixed values: answer patterns, tried in this order ----------------------
CHOICE_PATTERNS = (
    r"^选([A-D])",
    r"^选项([A-D])",
    r"答案是\s?选?项?\s?([A-D])",
    r"答案为\s?选?项?\s?([A-D])",
    r"答案应为\s?选?项?\s?([A-D])",
    r"答案选\s?选?项?\s?([A-D])",
    r"答案是:\s?选?项?\s?([A-D])",
    r"答案应该是:\s?选?项?\s?([A-D])",
    r"正确的一项是\s?([A-D])",
    r"答案为:\s?选?项?\s?([A-D])",
    r"答案应为:\s?选?项?\s?([A-D])",
    r"答案:\s?选?项?\s?([A-D])",
    r"答案是：\s?选?项?\s?([A-D])",
    r"答案应该是：\s?选?项?\s?([A-D])",
    r"答案为：\s?选?项?\s?([A-D])",
    r"答案应为：\s?选?项?\s?([A-D])",
    r"答案：\s?选?项?\s?([A-D])",
)

# --- fixed values: reply cleaning --------------------------------------------
DOCTOR_COLON = "doctor："  # removed literally by strip_markers (full-width colon)

# --- fixed values: numeric constants -----------------------------------------
IGNORE_INDEX = -100
CE_EPS = 1e-8            # masked cross-entropy denominator
NGRAM_EPS = 1e-10        # n-gram entropy / distinct-n denominator
RANK_BETA = 0.001        # L2 weight of the pairwise ranking loss
POLY_EPSILON = 1.0
PAD_MULTIPLE = 16
MAX_LENGTH = 2048
TARGET_RESERVE = 256     # max_src_length = max_length - 256
MIX_LENGTH_THRESHOLD = 256
MIX_PROBABILITY = 0.6
RANDOM_OFFSET_PROBABILITY = 0.5
SYSTEM_PROPERTY_DROPOUT = 0.5
LENGTH_WORDS_PER_BUCKET = 5
MAX_REMOTE_ATTEMPTS = 31

# --- fixed values: prompt/target collator tokens ------------------------------
GMASK = "[gMASK]"
SOP = "<sop>"
EOP = "<eop>"

# --- public constants of the metrics ------------------------------------------
F_EPS = 1e-8             # ROUGE-L F denominator
METEOR_ALPHA = 0.9
METEOR_BETA = 3.0
METEOR_GAMMA = 0.5

# --- our own defaults (not taken from the original project) ------------------
SEED = 29
EOS = "</s>"
PAD = "<pad>"
UNK = "<unk>"
# Tokens: role markers and other <|...|> / </s> specials stay whole, then
# Unicode words, then single non-space symbols.  Valid in Java regex and RE2.
TOKEN_PATTERN = r"<\|[a-z]+\|>|</s>|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\p{Cc}]"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
# Python str.strip() whitespace: \s, Unicode separators, U+001C..U+001F, U+0085
STRIP_CLASS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
DEFAULT_JUDGE_TEMPLATE = (
    "Rate the response against the reference answer from 0 to 10.\n"
    "Reference answer: [Answer]\nResponse: [Response]\nScore:"
)
SCORE_PATTERN = r"(?i)score\s*[:：]\s*(-?[0-9]+(?:\.[0-9]+)?)"
SPECIAL_TOKENS = (PAD, EOS, UNK, PATIENT, DOCTOR, SYSTEM, GMASK, SOP, EOP)

"""The long-form prep chain against a plain Python statement of the same rules,
on input with one very long conversation (several prefix-sum blocks)."""

import hashlib

import regex

from colloquy import constants as C
from colloquy.operators import sequences as S
from colloquy.operators import tokens as TK
from colloquy.session import materialize


def u(seed, salt, key):
    return int(hashlib.md5(f"{seed}:{salt}:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0


def python_chain(convs, vocab, max_length, p=0.5, seed=C.SEED):
    rx = regex.compile(C.TOKEN_PATTERN)
    out = {}
    for cid, turns in convs.items():
        toks = []
        for role, text in turns:
            marker = {"user": C.PATIENT, "assistant": C.DOCTOR, "system": C.SYSTEM}[role]
            toks += rx.findall(marker + text + C.EOS)
        idx, msg = -1, []
        for t in toks:
            if t in (C.PATIENT, C.DOCTOR):
                idx += 1
            msg.append(idx)
        n = len(toks)
        off = int((n - max_length + 1) * u(seed, "crop-offset", cid)) if (u(seed, "crop-mode", cid) < p and n > max_length) else 0
        ids = [vocab.get(t, 2) for t in toks[off:off + max_length]]
        m = [(x >= 0 and x % 2 == 1) for x in msg[off:off + max_length]]
        m[-1] = False
        out[cid] = (ids, m, off)
    return out


def test_encode_dialogues_matches_python_on_a_hot_conversation(spark):
    convs = {1: [("user" if i % 2 == 0 else "assistant", f"w{i % 17} x{i % 5}, y") for i in range(9000)],
             2: [("system", "be kind"), ("user", "hello there"), ("assistant", "hi!")],
             3: [("user", "only one turn")]}
    rows = [(cid, t, role, text) for cid, turns in convs.items() for t, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    pieces = materialize(S.piece_tokens(turns))
    vocab = TK.build_vocab(pieces, "toks")
    v = {r.token: r.token_id for r in vocab.collect()}
    for max_length in (64, 100000):
        got = {r.conv_id: (r.input_ids, r.label_mask, r.crop_offset)
               for r in S.encode_dialogues(pieces, vocab, max_length).collect()}
        want = python_chain(convs, v, max_length)
        assert got == want


def test_prefix_sums_move_no_tokens(spark):
    from colloquy.plans.numbering import running_sum

    turns = spark.createDataFrame([(1, t, "patient" if t % 2 else "doctor", f"words {t}") for t in range(50)],
                                  "conv_id long, turn long, role string, text string")
    pieces = materialize(S.piece_tokens(turns)).select("conv_id", "turn", "blk", "n_tok")
    df = running_sum(pieces, ["conv_id"], "turn", {"n_tok": "start"}, inclusive=False, block_col="blk")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "toks" not in p
    assert [r.start for r in df.orderBy("turn").collect()] == [4 * t for t in range(50)]  # marker, two words, end

def test_dialogue_batches_shapes(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "a b c " * (c % 7 + t)) for c in range(40) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = materialize(S.piece_tokens(turns))
    vocab = TK.build_vocab(pieces, "toks")
    out = S.dialogue_batches(pieces, vocab, max_length=32, batch_size=8).collect()
    assert len(out) == 40
    by_batch = {}
    for r in out:
        by_batch.setdefault(r.batch_id, []).append(r)
        assert len(r.input_ids) % C.PAD_MULTIPLE == 0
        assert len(r.input_ids) == len(r.attention_mask) == len(r.label_mask) == len(r.targets)
        assert r.targets == r.input_ids[1:] + r.input_ids[:1]
        assert r.length <= 32 and sum(r.attention_mask) == r.length
    for rs in by_batch.values():
        assert len({len(r.input_ids) for r in rs}) == 1

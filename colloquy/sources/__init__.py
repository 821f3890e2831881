"""Readers and writers."""

from .io import (read_dialogues, read_exam_csv, read_predictions, read_shard, read_split, read_template,
                 resume_predictions, write_dialogue_documents, write_dialogues, write_predictions, write_scored_csv, write_shards,
                 write_split)

__all__ = ["read_dialogues", "read_exam_csv", "read_predictions", "read_shard", "read_split", "read_template",
           "resume_predictions", "write_dialogue_documents", "write_dialogues", "write_predictions", "write_scored_csv", "write_shards",
           "write_split"]

"""Explicit schemas of every table; nothing is inferred at read time."""

from __future__ import annotations

PROSODY = (
    "struct<f0_mean:double,f0_std:double,f0_start:double,f0_end:double,"
    "f0_delta:double,f0_range:double>"
)
WORD_MAP_ENTRY = (
    "struct<standard_idx:int,dialect_idx:int,idx:int,dialect:string,standard:string,"
    "pronunciation:string>"
)
WORD_MAP = f"array<{WORD_MAP_ENTRY}>"
MARKED_WORDS = f"array<struct<word:string,marker:string,prosody:{PROSODY}>>"

SENTENCES = (
    "id string, do string, split string, speech_kind string, standard string, dialect string, "
    f"is_identical boolean, dialect_eojeol_map {WORD_MAP}, prosody {PROSODY}, "
    f"prosody_marker string, dialect_eojeol_prosody {MARKED_WORDS}, intent string, emotion string"
)

# One transcript file.
TRANSCRIPT = (
    "fileName string, "
    "transcription struct<"
    "sentences:array<struct<sentenceId:string,startTime:string,endTime:string,standard:string,"
    "dialect:string,intonations:array<double>>>,"
    "segments:array<struct<startTime:string,endTime:string,dialect:string,standard:string,"
    "pronunciation:string>>>, "
    "annotation struct<intents:array<struct<sentenceId:string,tagType:string>>,"
    "emotions:array<struct<sentenceId:string,tagType:string>>>"
)
LEGACY_TRANSCRIPT = (
    "utterance array<struct<id:string,standard_form:string,dialect_form:string,"
    "eojeolList:array<struct<id:string,eojeol:string,standard:string>>>>"
)
TRAINER_STATE = (
    "global_step bigint, log_history array<struct<step:bigint,grad_norm:double,"
    "frac_reward_zero_std:double,reward:double,reward_std:double,kl:double,"
    "`completions/clipped_ratio`:double>>"
)

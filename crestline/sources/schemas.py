"""Schemas of the tables and documents, stated once; nothing is inferred from data."""

from __future__ import annotations

MESSAGES = "job_id string, ts double, author string, text string"
AUDIO_WINDOWS = "job_id string, idx int, time double, rms double, centroid double, zcr double, flux double, onset double, pitch_var double"
CLASS_WINDOWS = "job_id string, time double, speech_presence double, vocal_excitement double, game_audio double"
CHAT_WINDOWS = (
    "job_id string, time double, chat_speed double, chat_burst double, caps_ratio double, unique_ratio double, "
    "emote_density double, sentiment_hype double, sentiment_fun double, sentiment_rip double, sentiment_intensity double, dominant_mood string"
)
SIGNALS = (
    "struct<rms: double, spectral_flux: double, pitch_variance: double, spectral_centroid: double, zcr: double, "
    "chat_speed: double, vocal_excitement: double, speech_presence: double>"
)
KEY_MOMENT = "struct<time: double, label: string, description: string>"
LLM_ANALYSIS = f"struct<transcript: string, speech_rate: double, category: string, virality_score: double, summary: string, key_moments: array<{KEY_MOMENT}>>"
HOT_POINT = (
    f"struct<timestamp_seconds: double, timestamp_display: string, score: double, final_score: double, signals: {SIGNALS}, chat_mood: string, "
    f"clip_start: double, clip_end: double, clip_filename: string, clip_name: string, clip_source: string, llm: {LLM_ANALYSIS}>"
)
JOBS = (
    "job_id string, user_id bigint, url string, status string, error string, progress string, vod_title string, custom_title string, "
    "vod_duration_seconds double, vod_game string, vod_game_id string, streamer string, streamer_thumbnail string, view_count bigint, "
    f"stream_date string, creator_id bigint, created_at timestamp, step_timings map<string, struct<start: double, duration: double>>, hot_points array<{HOT_POINT}>"
)
RENDERS = (
    "id string, job_id string, user_id bigint, clip_filename string, clip_name string, status string, progress double, "
    "output_filename string, size_mb double, error string, batch_group_id string, created_at timestamp"
)
CREATORS = "id bigint, user_id bigint, twitch_id string, login string, display_name string, thumbnail string"
WORDS = "clip_id string, ord int, word string, start double, end double, speaker string"
TURNS = "clip_id string, ord int, speaker string, start double, end double"
KEYFRAMES = "array<struct<time: double, easing: string, x: double, y: double, width: double, height: double, rotation: double, opacity: double, scale: double, borderRadius: double, blur: double>>"

#: States of a job in order.  Fixed values.
JOB_STATES = ("PENDING", "DOWNLOADING", "ANALYZING", "SCORING", "TRANSCRIBING", "CLIPPING", "LLM_ANALYSIS", "DONE", "ERROR")
CLIP_SOURCES = ("auto", "manual", "llm_detected")

"""Readers: tables, text cues, manifests, journals, cue sheets."""

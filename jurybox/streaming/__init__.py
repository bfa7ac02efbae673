"""Incremental judging of samples that arrive over time."""

from jurybox.streaming.incremental import judge_new_samples

__all__ = ["judge_new_samples"]

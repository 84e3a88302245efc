"""Readers, writers and the views that stand for rollout logs."""

"""The two phases: stage drafts, then plan edits."""

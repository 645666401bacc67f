"""Fitted steps on a stream. A fitted transform is a projection, so it needs no state."""

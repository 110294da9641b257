"""Text, snapshots and generated streams."""

"""Schema-driven decoding of account, instruction and event bytes."""

"""Distributed operators; each module is one stage of a study."""

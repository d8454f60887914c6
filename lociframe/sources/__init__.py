"""Readers and writers of the text formats of pool sequencing."""

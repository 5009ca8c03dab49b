"""Inputs are whole files; nothing of the operators here is a stream. resume.py keeps what files are done."""

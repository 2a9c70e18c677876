"""Noticeboard: batch and streaming analytics over large collections of official notices."""

"""Whole studies: folds, transforms, ensembles and scores in one plan per stage."""

"""Readers of note trees and tracker exports."""

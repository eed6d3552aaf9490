"""Running counts over arriving fragments."""

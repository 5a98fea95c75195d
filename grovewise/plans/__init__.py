"""The registered queries; importing this package registers them."""

from grovewise.plans import changes, paths, relations, sources, transforms, trees, values

REGISTERED = (changes, paths, relations, sources, transforms, trees, values)

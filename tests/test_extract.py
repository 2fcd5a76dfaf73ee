"""What each extractor must find in a small file of its language."""

import pytest

from lexiloom.extract import extract_all, parse_files, relations

SAMPLES = {
'a.rs':'''use crate::util::{clamp, Mixer as M};
use std::fs;
/// Plays things.
pub struct Player {
    pub rate: u32,
    gain: f32,
}
impl Player {
    /// Makes one.
    pub fn new(rate: u32) -> Self { Self { rate, gain: clamp(1.0) } }
    pub(crate) fn play(&mut self, xs: &[f32]) -> f32 { let y = scale(xs[0]); self.stop(); y }
}
fn scale(x: f32) -> f32 { x * 2.0 }
const LIMIT: usize = 3;
type Pair = (u8, u8);
enum State { 
    On, 
    Off(u8),
}
trait Source { fn pull(&self); }
macro_rules! shout { () => {} }
''',
'a.ts':'''import { Emitter } from 'events';
export interface Options { port: number }
export class Host extends Emitter {
  private port: number;
  constructor(o: Options) { super(); this.port = o.port; }
  start(): void { listen(this.port); }
}
export function makeHost(o: Options): Host { return new Host(o); }
const LIMIT = 5;
type Id = string | number;
const twice = (x: number) => x * 2;
''',
'a.py':'''import os
from a.b import c, d
class Store:
    """Keeps rows."""
    def open(self, x): return connect(x)
def connect(x):
    "doc"
    return Store()
LIMIT = 3
''',
'a.go':'''package main
import (
 "fmt"
 "math"
)
const Limit = 3
var count int
type Gain float64
type Player struct { rate int }
type Source interface { Pull() }
func (p *Player) Play(x float64) float64 { fmt.Println(x); return Scale(x) }
func Scale(x float64) float64 { return math.Abs(x) }
''',
'a.swift':'''import Foundation
public class Player { func play() { scale(1) } }
struct Point { var x: Int }
enum State { case on }
protocol Source { func pull() }
func scale(_ x: Int) -> Int { return x }
''',
'a.dart':'''import 'dart:async' show Timer, Future;
abstract class Shape { double area(); }
class Circle extends Shape { final double r; Circle(this.r); double area() { return square(r); } }
mixin Loud { void shout() { print('x'); } }
enum Color { red }
typedef Op = int Function(int);
double square(double x) => x * x;
''',
'a.kt':'''package x
import a.b.C
import d.e
enum class Color { RED }
interface Shape { fun area(): Double }
class Circle(val r: Double) : Shape { override fun area(): Double { return square(r) } }
object Tool { fun go() { square(1.0) } }
fun square(x: Double): Double = x * x
''',
'a.c':'''#include <stdio.h>
#include "x.h"
#define LIMIT 3
typedef enum { A, B } State;
typedef struct { int r; } Player;
typedef float Sample;
float scale(float x) { return x; }
void play(Player *p) { scale(1); }
''',
'a.cpp':'''#include <vector>
#include "x.h"
enum class State { A };
using Sample = float;
namespace audio {
class Player { public: Player(int r); void play() { scale(1); } private: int rate_; };
class Engine { public: void run(); };
float scale(float x) { return x; }
}
''',
'a.vue':'''<template><p/></template>
<script lang="ts">
export interface User { id: number }
export type Id = string
enum Color { Red }
</script>
<script setup>
function setupThing() { go() }
</script>
''',
}

FACTS = {
    "a.rs": ({"Player#struct", "Player::rate#field", "Player::new#method", "Player::play#method", "scale#function", "LIMIT#constant", "Pair#type_alias", "State#enum", "State::On#variant", "Source#interface", "shout#macro"}, {("new", "clamp"), ("play", "scale")}, {"crate::util", "std"}),
    "a.ts": ({"Options#interface", "Host#class", "Host::start#method", "Host::port#field", "makeHost#function", "LIMIT#constant", "Id#type_alias", "twice#function"}, {("start", "listen")}, {"events"}),
    "a.py": ({"Store#class", "Store::open#method", "connect#function"}, {("open", "connect")}, {"os", "a.b"}),
    "a.go": ({"Limit#constant", "count#variable", "Gain#type_alias", "Player#struct", "Source#interface", "Player::Play#method", "Scale#function"}, {("Play", "Scale"), ("Play", "fmt.Println")}, {"fmt", "math"}),
    "a.swift": ({"Player#class", "Player::play#method", "Point#struct", "State#enum", "Source#interface", "scale#function"}, {("play", "scale")}, {"Foundation"}),
    "a.dart": ({"Shape#interface", "Circle#class", "Circle::area#method", "Loud#interface", "Color#enum", "Op#type_alias", "square#function"}, {("area", "square")}, {"dart:async"}),
    "a.kt": ({"Color#enum", "Shape#interface", "Circle#class", "Circle::area#method", "Tool#class", "square#function"}, {("area", "square"), ("go", "square")}, {"a.b.C", "d.e"}),
    "a.c": ({"LIMIT#macro", "State#enum", "Player#struct", "Sample#type_alias", "scale#function", "play#function"}, {("play", "scale")}, {"stdio.h", "x.h"}),
    "a.cpp": ({"State#enum", "Sample#type_alias", "audio#module", "audio::Player#class", "audio::Player::play#method", "audio::scale#function"}, {("play", "scale")}, {"vector", "x.h"}),
    "a.vue": ({"User#interface", "Id#type_alias", "Color#enum", "setupThing#function"}, {("setupThing", "go")}, set()),
}


@pytest.mark.parametrize("path", SAMPLES)
def test_facts(path):
    out = extract_all(path, SAMPLES[path])
    symbols, calls, imports = FACTS[path]
    assert symbols <= {f"{s['qualified_name']}#{s['kind']}" for s in out["symbols"]}
    if path != "a.vue":
        assert calls <= {(e["caller"], e["callee"]) for e in out["call_edges"]}
    assert imports <= {i["module_path"] for i in out["imports"]}
    assert out["identifiers"]


def test_vue_lines_count_in_the_file():
    lines = {s["name"]: s["span"]["start_line"] for s in extract_all("a.vue", SAMPLES["a.vue"])["symbols"]}
    assert lines["User"] == 3 and lines["setupThing"] == 8


def test_python_constants_are_no_symbols():
    assert "LIMIT" not in {s["name"] for s in extract_all("a.py", SAMPLES["a.py"])["symbols"]}


def test_parse_files_survives_broken_ones(spark):
    rows = [*SAMPLES.items(), ("bad.py", "def ("), ("none.py", None), ("empty.rs", ""), ("odd.c", "}}}{{{ \x00 ((")]
    parsed = parse_files(spark.createDataFrame(rows, "file_path string, content string")).persist()
    status = {r["file_path"]: r["status"] for r in parsed.select("file_path", "status").collect()}
    assert status["bad.py"] == status["none.py"] == "failed"
    assert status["a.rs"] == status["empty.rs"] == status["odd.c"] == "parsed"
    tables = relations(parsed)
    assert tables["symbols"].where("file_path = 'a.rs'").count() >= 11
    assert tables["identifiers"].where("name = 'scale' and ref_kind = 'Definition'").count() >= 3

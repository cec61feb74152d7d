"""The languages with braces: what a reader would list, for one file each."""

import pytest

from lodestar.sources import parsers

RUST = '''//! Sums things up.
use std::{collections::{HashMap, HashSet}, fmt};
pub use crate::model::Row as R;

/// A point. Of two numbers.
#[derive(Debug)]
pub struct Point<T> { x: T, y: T }

impl<T: Clone> Point<T> {
    /// Moves it.
    pub fn moved(
        &self,
        by: T, // "not { a string"
    ) -> Self where T: Copy {
        let s = "} not the end";
        let c = '{';
        self.shift::<T>(by);
        helper(c)
    }
    fn shift(&self) {}
}

impl fmt::Display for Point<u8> {
    fn fmt(&self) {}
}

pub trait Walk { fn step(&self); fn twice(&self) { self.step() } }
enum Kind { A, B(u8) }
const MAX: usize = 3;
mod inner { pub fn deep() { super::helper('a') } }
/* block
 * comment */
fn helper(c: char) -> Vec<u8> { r#"raw " } "#; Vec::new() }
'''

TYPESCRIPT = '''/* Handles users. */
import def, { a, b as c } from "./mod";
import * as path from 'path';
const { readFile } = require("fs");
export { x } from './x';

export interface User { name: string }
export type Id = string | number;
export enum Color { Red }
/** Makes a user. */
export const make = async (name: string): Promise<User> => {
  return build(`tpl ${name} }`);
};
const LIMIT = 3;
function plain(cb = () => { inner(); }) { return cb(); }
export class Box<T> extends Base<T> {
  private count = 0;
  constructor(private x: T) { super(); this.init(); }
  async open(
    key: string,
  ): Promise<void> {
    if (key) { this.run(key); }
  }
  private static hide() {}
}
'''

GO = '''// Package store keeps rows.
package store

import (
\t"fmt"
\tm "example.com/model"
)

type Row struct { ID int }
type Reader interface { Read() }
type Name = string

func New(
\ta int,
) *Row {
\tfmt.Println(`{`)
\treturn build(a)
}

func (r *Row) Save() error { return r.check() }
func (r Row) check() error { return nil }
'''

JAVA = '''// Copyright nobody
package a.b;
import java.util.List;
import static a.b.C.*;

public class Shop extends Base implements Runnable {
    private final Map<String, List<Integer>> m = new HashMap<>();
    public Shop(int a) { super(a); init(); }
    /** Buys. And pays. */
    @Override
    public <T> List<T> buy(String what, Map<String, T> how)
            throws IOException {
        if (what == null) { return cheap(what); }
        return this.pay("}" + what);
    }
    protected abstract void later(int x);
    enum Size { S, M }
    interface Seen { void see(); }
}
record Pair(int a, int b) {}
'''

CSHARP = '''using System;
using static System.Math;
namespace Shop.Core {
    public record Item(string Name);
    public struct Money { public int Cents; }
    public class Card { public string Owner { get; set; } public int Sum => 3; }
    internal sealed class Till : IDisposable {
        public Till(int a) : base(a) { Open(); }
        public async Task<List<int>> Count<T>(int a) where T : new() { return await Sum(a, @"c:\\x}"); }
        private int Half(int a) => Divide(a, 2);
    }
}
'''

KOTLIN = '''import a.b.C
import a.b.d.*
data class P(val x: Int)
sealed interface Shape
object Single { fun go() { run() } }
class Box<T>(val t: T) : Base() {
    private val n = 3
    private fun hidden() = helper(t)
    fun <R> T.mapped(f: (T) -> R): R {
        return f(this)
    }
}
fun main() {
    println("}")
    start()
}
'''

CPP = '''#include <vector>
#include "own/part.h"
#define LIMIT 10
namespace ns {
class Box : public Base {
    int hidden() { return 1; }
public:
    Box(int a) : Base(a), n(a) { init(); }
    int size() const { return count(this->n); }
private:
    int n;
};
struct Plain { int a; int get() { return a; } };
enum class Color { Red };
template <typename T> T twice(T a) {
    return ns::add<T>(a, a);
}
int Box::later(int x) {
    if (x) { return go(x); }
    return 0;
}
typedef unsigned int uint;
}
static int local_only(void) { return 0; }
'''


def read(text, name, language):
    p = parsers.parse(text, name, "f", language)
    names = {s["id"]: s["name"] for s in p.symbols}
    at = {s["start"]: s["name"] for s in p.symbols if s["kind"] in ("function", "method")}
    symbols = [(s["name"], s["kind"], names.get(s["parent"]), s["exported"]) for s in p.symbols]
    return p, symbols, {(at[c["caller_line"]], c["callee"], c["is_method"]) for c in p.calls}, [(i["import_path"], i["names"]) for i in p.imports]


def test_rust():
    p, symbols, calls, imports = read(RUST, "a.rs", "rust")
    assert symbols == [
        ("Point", "struct", None, True), ("Point", "impl", "Point", False), ("moved", "method", "Point", True), ("shift", "method", "Point", False), ("Point", "impl", "Point", False), ("fmt", "method", "Point", False),
        ("Walk", "trait", None, True), ("step", "method", "Walk", False), ("twice", "method", "Walk", False), ("Kind", "enum", None, False), ("MAX", "constant", None, False), ("inner", "module", None, False), ("deep", "function", "inner", True), ("helper", "function", None, False),
    ]
    assert calls == {("moved", "shift", True), ("moved", "helper", False), ("twice", "step", True), ("deep", "helper", False), ("helper", "new", False)}
    assert imports == [("std", ["fmt"]), ("std::collections", ["HashMap", "HashSet"]), ("crate::model::Row", ["Row"])]
    moved = p.symbols[2]
    assert (moved["start"], moved["end"], moved["doc"]) == (11, 19, "Moves it.") and moved["signature"].endswith("-> Self where T: Copy")
    assert p.symbols[0]["doc"] == "A point" and p.module_doc == "Sums things up."
    assert {"block comment", '"not { a string"'} <= {c["text"] for c in p.comments}


def test_typescript():
    p, symbols, calls, imports = read(TYPESCRIPT, "a.ts", "typescript")
    assert symbols == [
        ("User", "interface", None, True), ("Id", "type_alias", None, True), ("Color", "enum", None, True), ("make", "function", None, True), ("LIMIT", "variable", None, False), ("plain", "function", None, False), ("Box", "class", None, True),
        ("constructor", "function", "Box", False), ("open", "method", "Box", False), ("hide", "method", "Box", False),
    ]
    assert {("make", "build", False), ("plain", "cb", False), ("constructor", "init", True), ("open", "run", True)} <= calls
    assert imports[:2] == [("./mod", ["def", "a", "b"]), ("path", ["path"])] and ("fs", ["readFile"]) in imports and ("./x", ["x"]) in imports
    assert p.module_doc == "Handles users." and next(s for s in p.symbols if s["name"] == "make")["doc"] == "Makes a user."
    assert parsers.parse(TYPESCRIPT, "a.js", "f", "javascript") == p


def test_go():
    p, symbols, calls, imports = read(GO, "a.go", "go")
    assert symbols == [("Row", "struct", None, True), ("Reader", "interface", None, True), ("Name", "type_alias", None, True), ("New", "function", None, True), ("Save", "method", "Row", True), ("check", "method", "Row", False)]
    assert calls == {("New", "Println", True), ("New", "build", False), ("Save", "check", True)}
    assert imports == [("fmt", []), ("example.com/model", [])] and p.module_doc == "Package store keeps rows."


def test_java():
    p, symbols, calls, imports = read(JAVA, "A.java", "java")
    assert symbols == [("Shop", "class", None, True), ("m", "variable", "Shop", False), ("Shop", "function", "Shop", True), ("buy", "method", "Shop", True), ("later", "method", "Shop", False), ("Size", "enum", "Shop", False), ("Seen", "interface", "Shop", False), ("see", "method", "Seen", False), ("Pair", "class", None, False)]
    assert calls == {("Shop", "init", False), ("buy", "cheap", False), ("buy", "pay", True)}
    assert imports == [("java.util.List", ["List"]), ("a.b.C", [])] and p.module_doc is None
    assert next(s for s in p.symbols if s["name"] == "buy")["doc"] == "Buys"


def test_csharp():
    _, symbols, calls, imports = read(CSHARP, "A.cs", "csharp")
    assert symbols == [("Shop.Core", "module", None, False), ("Item", "class", "Shop.Core", True), ("Money", "struct", "Shop.Core", True), ("Card", "class", "Shop.Core", True), ("Owner", "variable", "Card", True), ("Sum", "variable", "Card", True), ("Till", "class", "Shop.Core", False), ("Till", "function", "Till", True), ("Count", "method", "Till", True), ("Half", "method", "Till", False)]
    assert calls == {("Till", "Open", False), ("Count", "Sum", False), ("Half", "Divide", False)} and imports == [("System", []), ("System.Math", [])]


def test_kotlin():
    _, symbols, calls, imports = read(KOTLIN, "a.kt", "kotlin")
    assert symbols == [("P", "class", None, True), ("Shape", "interface", None, True), ("Single", "class", None, True), ("go", "method", "Single", True), ("Box", "class", None, True), ("n", "variable", "Box", False), ("hidden", "method", "Box", False), ("mapped", "method", "Box", True), ("main", "function", None, True)]
    assert {("go", "run", False), ("hidden", "helper", False), ("mapped", "f", False), ("main", "start", False)} <= calls and imports == [("a.b.C", ["C"]), ("a.b.d", [])]


def test_cpp():
    _, symbols, calls, imports = read(CPP, "a.cpp", "cpp")
    assert symbols == [
        ("LIMIT", "constant", None, True), ("ns", "module", None, True), ("Box", "class", "ns", True), ("hidden", "method", "Box", False), ("Box", "method", "Box", True), ("size", "method", "Box", True), ("Plain", "struct", "ns", True),
        ("get", "method", "Plain", True), ("Color", "enum", "ns", True), ("twice", "function", "ns", True), ("later", "method", "Box", True), ("uint", "type_alias", "ns", True), ("local_only", "function", None, True),
    ]
    assert {("Box", "init", False), ("size", "count", False), ("twice", "add", False), ("later", "go", False)} <= calls and imports == [("vector", []), ("own/part.h", [])]


@pytest.mark.parametrize("language", ["rust", "typescript", "go", "java", "csharp", "kotlin", "cpp", "c", "javascript"])
def test_odd_texts(language):
    for text in ("", "\n", "{", "}}}", '"', "/*", "fn", "class", "\x00é漢", "(" * 2000, "{" * 2000, "a" * 20_000, "class A { " * 200, "'" * 501, "/* " * 300, "x = \"\\"):
        parsers.parse(text, "x", "f", language)
